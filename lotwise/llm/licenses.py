"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Windows of WINDOW words start every STRIDE words; those that share a shingle with a template (the others have
similarity zero) get BANDS MinHash values, each a band of its own. A template of m shingles inside a window of n has
similarity m / n at least, so bands of one row miss it with chance (1 - m / n) ** BANDS: below 0.0005 for the shortest
notice here. Retrieved templates are verified on the window widened by the template's length on both sides: the share
of the template's shingles found there, by count, must reach the containment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import anchors, with_shingles
from .common import id_and_text, load, stage

K, WINDOW, STRIDE, BANDS = 3, 16, 8, 32

# Short public licence notices and the SPDX names of their licences.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

_BAND = f"transform(sequence(0, {BANDS - 1}), i -> named_struct('i', i, 'v', array_min(transform(sh, x -> xxhash64(x, i)))))"


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, containment: float = 0.8) -> DataFrame:
    """(doc_id, license, start, containment): a row for each license that a document names.

    start is the first word of the first window that holds it, containment the best share found. Where notices overlap,
    only those with the best share count. Words are lower-case
    runs of letters and digits. Null, empty and texts of fewer than three words name none. A null doc_id stays null;
    rows of one doc_id and license are one row. The notices are a fixed list, so broadcasting them is bounded.
    """
    spark = docs.sparkSession
    notices = NOTICES if notices is None else notices
    items = spark.createDataFrame([(i, lic, text) for i, (lic, text) in enumerate(notices)], "item long, license string, text string")
    items = stage(with_shingles(items, K, "item", "license").where("size(sh) > 0").select("item", "license", "sh", F.size("wh").alias("len")), "notices")
    table = items.select("item", F.posexplode("sh").alias("at", "h"))
    rows = id_and_text(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    found = anchors(rows, table, K).select("key", F.explode(F.expr(f"sequence(greatest(pos div {STRIDE} - 1, 0), pos div {STRIDE})")).alias("w"))
    spots = stage(found.distinct(), "license-spots")
    texts = with_shingles(rows.join(spots.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), K, "key", "doc_id")
    own = f"slice(all_sh, w * {STRIDE} + 1, {WINDOW - K + 1})"
    windows = (
        texts.select("key", "doc_id", F.col("sh").alias("all_sh")).join(spots, "key").where(f"size(all_sh) > w * {STRIDE}")
        .select("key", "doc_id", "w", "all_sh", F.expr(own).alias("sh"))
    )
    bands = windows.select("key", "doc_id", "w", "all_sh", F.explode_outer(F.expr(_BAND)).alias("b")).select("key", "doc_id", "w", "all_sh", "b.*")
    marks = items.select("item", "license", "len", F.col("sh").alias("item_sh"), F.explode_outer(F.expr(_BAND)).alias("b"))
    hits = bands.join(F.broadcast(marks.select("item", "license", "len", "item_sh", "b.*")), ["i", "v"])
    wide = f"slice(all_sh, greatest(w * {STRIDE} - len, 0) + 1, {WINDOW - K + 1} + 2 * len)"
    common = """aggregate(array_intersect(region, item_sh), 0, (s, x) ->
        s + least(size(filter(region, y -> y = x)), size(filter(item_sh, y -> y = x)))) / size(item_sh)"""
    scored = hits.select("key", "doc_id", "w", "license", "item_sh", F.expr(wide).alias("region")).distinct()
    scored = scored.withColumn("containment", F.expr(common)).where(F.col("containment") >= containment)
    best = F.max("containment").over(Window.partitionBy("key", "w"))  # notices alike but for a version or a letter
    return (
        scored.withColumn("best", best).where("containment = best").groupBy("doc_id", "license")
        .agg((F.min("w") * STRIDE).cast("int").alias("start"), F.max("containment").alias("containment"))
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return scan(load(spark, sf_dir, "documents"))


