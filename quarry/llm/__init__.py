"""Training-data operators: chat formatting, packing, quality, language-model
scoring, secret scans, decontamination, line and near-duplicate removal, WARC, hard negatives, manifests and mixtures.

Nothing outside this subpackage imports it.
"""
