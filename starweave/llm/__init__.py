"""Training-data operators for large text corpora.

One module for each operator; nothing else in the package imports them.

=====================  ==========================================================
``chat``               reply trees and chat formatting (native)
``urls``               URL rules and an n-gram logistic regression (native)
``packing``            best-fit packing with dominance reduction
``licenses``           positional rare-token licence scan (native)
``media``              telephony audio columns
``decontam``           SimHash windows against a benchmark (native)
``linededup``          content-defined line chunks (native)
``quality``            hierarchical empirical-Bayes quality classifier
``simhash``            SimHash near-duplicates over pivot distance tables
``lpf``                longest-previous-factor removal of repeated byte strings
``secrets``            secret patterns and a token-efficiency test
``clusters``           exact k-means with Yinyang bounds
``negatives``          hard negatives by distributed radix selection
=====================  ==========================================================
"""
