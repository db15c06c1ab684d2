"""All queries of this subpackage by name, with their SQL."""

from __future__ import annotations

from tessera.llm import queries as q


def queries() -> dict:
    return {"p2_found": q.p2_found, "p2_ranking": q.p2_ranking, "p3_found": q.p3_found, "p3_texts": q.p3_texts, "p5_found": q.p5_found, "p5_canonical": q.p5_canonical, "p5_classes": q.p5_classes, "p6_found": q.p6_found, "p6_pieces": q.p6_pieces, "p6_joined_again": q.p6_joined_again, "p7_ids": q.p7_ids, "p8_containers": q.p8_containers, "p9_found": q.p9_found, "p9_line_shares": q.p9_line_shares}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": q.P5_FOUND_SQL, "p5_canonical": q.P5_CANONICAL_SQL, "p5_classes": q.P5_CLASSES_SQL, "p6_found": q.P6_FOUND_SQL, "p6_joined_again": q.P6_JOINED_SQL}
