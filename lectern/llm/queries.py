"""Registered queries of the training-text operators: name → callable(spark, sf_dir)."""

from __future__ import annotations

from lectern.llm import boilerplate, cooccurrence, languages, leakage, names, nearcopies, repeats, sentences, tokenizer

QUERIES = {
    "p2_found": cooccurrence.p2_found,
    "p2_updated": cooccurrence.p2_updated,
    "p3_found": names.p3_found,
    "p3_clusters": names.p3_clusters,
    "p4_found": nearcopies.p4_found,
    "p4_classes": nearcopies.p4_classes,
    "p5_found": boilerplate.p5_found,
    "p5_stories": boilerplate.p5_stories,
    "p6_found": sentences.p6_found,
    "p7_found": repeats.p7_found,
    "p7_blocks": repeats.p7_blocks,
    "p8_ids": tokenizer.p8_ids,
    "p9_found": leakage.p9_found,
    "p9_clean": leakage.p9_clean,
    "p10_found": languages.p10_found,
    "p10_segments": languages.p10_segments,
}
