"""All registered queries and the SQL each is checked against."""

from __future__ import annotations

from . import image_batches, matching, point_clouds, run_history, streams, texts, timelines

FAMILIES = (run_history, point_clouds, image_batches, matching, timelines, texts, streams)

QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
