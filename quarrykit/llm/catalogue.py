"""Named queries of the training-data operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from quarrykit.llm import p1_handwritten, p2_pairs, p3_split, p4_splits, p5_overlap, p6_topn, p7_docpairs, p8_tokenize, p9_leaks, p10_quality

_MODULES = (p1_handwritten, p2_pairs, p3_split, p4_splits, p5_overlap, p6_topn, p7_docpairs, p8_tokenize, p9_leaks, p10_quality)

#: Every function of the modules above that is named for a query.
QUERIES: dict = {name: f for m in _MODULES for name, f in vars(m).items() if name[:1] == "p" and name[1:2].isdigit() and callable(f)}
SQL: dict = {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}
