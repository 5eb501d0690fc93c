"""Operators for training-data pipelines: chat windows, packing, sub-word
transducers, weak-label quality, SimHash links, polynomial fingerprints,
line rules, toxicity, WARC and secret scans, hard negatives, conversation
repair and main text of pages.  Nothing else in the library imports this
package."""
