"""Corpus operators over the texts, faces and pages that screening leaves behind.

They prepare training data from screened documents: filtering, packing, sharding, tokenizing and finding copies.
Nothing else in the library imports this subpackage.
"""
