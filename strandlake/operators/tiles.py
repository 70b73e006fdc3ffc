"""Contigs in tiles: no row holds more letters than a tile and its halo.

A tile table has contig, tile and letters: tile k of width w holds the letters from k*w on. What needs
letters at a position joins by (contig, tile). Patterns that cross a cut read on into a halo, the
first letters of the tile after; what grows without bound, as an indel over a repeat, is carried from tile to tile.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.expr import motif_regex
from strandlake.operators.prefix import running
from strandlake.session import discard, materialize

WIDTH = 10_000


def from_contigs(contigs: DataFrame, contig: str = "contig", seq: str = "seq", width: int = WIDTH) -> DataFrame:
    """Tiles of contigs that are one row each; for contigs that do not fit a row see :func:`from_fasta`."""
    # Extracting runs reads a sequence once, where substring() would count from its beginning for each tile.
    parts = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    return contigs.select(F.col(contig).alias("contig"), F.posexplode(parts).alias("tile", "letters")).withColumn("tile", F.col("tile").cast("long"))


def of(contigs: DataFrame, contig: str = "contig", width: int = WIDTH) -> DataFrame:
    """``contigs`` if they are tiles already, else their tiles."""
    return contigs if "tile" in contigs.columns else from_contigs(contigs, contig, width=width)


def from_fasta(spark: SparkSession, path: str, width: int = WIDTH) -> DataFrame:
    """Tiles of FASTA text, from its lines: a contig's letters never meet in one row. A contig is known by the first word of its header."""
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # Lines of one block of a file are read in order by one task, so that numbers within it are in order.
    lines = spark.read.text(path).select(block.alias("at"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value")).select("at.file", "at.block", "line", "value")
    head = F.col("value").startswith(">")
    counts = running(lines, ["file"], ["block", "line"], F.col("block"), {"headers": head.cast("long"), "letters": F.when(head, 0).otherwise(F.length("value")).cast("long")})
    names = counts.where(head).select("file", (F.col("headers") + 1).alias("headers"), F.split(F.substring("value", 2, 1 << 30), r"\s+")[0].alias("contig"), F.col("letters").alias("base"))
    rows = counts.where(~head & (F.col("value") != "")).join(names, ["file", "headers"]).select("contig", (F.col("letters") - F.col("base")).alias("start"), "value")
    return _assemble(rows, width)


def _assemble(rows: DataFrame, width: int) -> DataFrame:
    """Tiles from runs of letters: contig, start, value."""
    start, end = F.col("start"), F.col("start") + F.length("value")
    cut = rows.withColumn("tile", F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width))))
    begin, stop = F.greatest(start, F.col("tile") * width), F.least(end, (F.col("tile") + 1) * width)
    part = F.substring("value", (begin - start + 1).cast("int"), (stop - begin).cast("int"))
    pieces = cut.select("contig", "tile", F.struct(begin.alias("b"), part.alias("x")).alias("p"))
    return pieces.groupBy("contig", "tile").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"]), "").alias("letters"))


def with_halo(tiles: DataFrame, halo: int) -> DataFrame:
    """Adds ahead: the first ``halo`` letters after the tile, fewer at a contig's end."""
    if halo <= 0:
        return tiles.withColumn("ahead", F.lit(""))
    after = tiles.where("tile > 0").select("contig", (F.col("tile") - 1).alias("tile"), F.lit(None).cast("string").alias("letters"), F.substring("letters", 1, halo).alias("ahead"))
    both = tiles.select("contig", "tile", "letters", F.lit("").alias("ahead")).unionByName(after)
    return both.groupBy("contig", "tile").agg(F.max("letters").alias("letters"), F.max("ahead").alias("ahead"))


def motif_starts(tiles: DataFrame, motif: str, width: int = WIDTH) -> DataFrame:
    """contig, pos (0-based, of the motif's first letter) of every hit, overlapping ones included."""
    if len(motif) - 1 > width:
        raise ValueError("a motif may be no longer than a tile")
    # Marking the first letter of each hit reads a tile once; the marks then are rows.
    marked = F.regexp_replace(F.concat("letters", "ahead"), f"(?={motif_regex(motif, False)}).", "1")
    cells = with_halo(tiles, len(motif) - 1).select("contig", "tile", F.length("letters").alias("n"), F.posexplode(F.split(marked, "")).alias("i", "mark"))
    return cells.where("mark = '1' and i < n").select("contig", (F.col("tile") * width + F.col("i")).alias("pos"))


def letters_at(rows: DataFrame, tiles: DataFrame, at: Column, width: int = WIDTH, how: str = "left") -> DataFrame:
    """Adds letter: the contig's at position ``at``, null beyond its ends. ``rows`` has contig."""
    x = rows.withColumn("_at", at).withColumn("tile", F.floor(F.col("_at") / width))
    y = x.join(tiles.select("contig", "tile", "letters"), ["contig", "tile"], how)
    one = F.substring("letters", (F.col("_at") - F.col("tile") * width + 1).cast("int"), F.lit(1))
    return y.select(*rows.columns, F.when(one != "", one).alias("letter"))


def mismatches(rows: DataFrame, tiles: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (contig, pos, ref) that the contig does not read, each stretch of ``ref`` compared within its tile."""
    n = F.length("ref")
    x = rows.select("contig", "pos", "ref").distinct()
    cut = x.withColumn("tile", F.explode(F.when(n == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.floor(F.col("pos") / width), F.floor((F.col("pos") + n - 1) / width)))))
    begin = F.greatest(F.col("pos"), F.col("tile") * width)
    stop = F.least(F.col("pos") + n, (F.col("tile") + 1) * width)
    want = F.when(n == 0, "").otherwise(F.substring("ref", (begin - F.col("pos") + 1).cast("int"), (stop - begin).cast("int")))
    y = cut.join(tiles.select("contig", "tile", "letters"), ["contig", "tile"], "left")
    there = F.when(n == 0, "").otherwise(F.substring("letters", (begin - F.col("tile") * width + 1).cast("int"), (stop - begin).cast("int")))
    return y.where(F.col("letters").isNull() | (there != want)).select("contig", "pos", "ref").distinct()


def repeat_reach(indels: DataFrame, tiles: DataFrame, backward: bool, width: int = WIDTH) -> DataFrame:
    """How far letters go on repeating an indel's own ones, before it (backward) or after it.

    ``indels``: distinct contig, pos, ref, alt of which one allele is empty. Adds reach, null where the
    contig's end is met. What still repeats at a tile's edge is carried on to the next one, so that
    a round takes rows one tile further; there are as many rounds as the longest repeat has tiles, and one.
    """

    @F.pandas_udf("struct<reach:long,state:string>")
    def follow(unit: pd.Series, reach: pd.Series, inside: pd.Series, letters: pd.Series) -> pd.DataFrame:
        out = []
        for u, far, at, x in zip(unit, reach, inside, letters, strict=True):
            if x is None or at >= len(x):
                out.append((far, "end"))
                continue
            size, step = len(u), -1 if backward else 1
            while 0 <= at < len(x) and x[at] == (u[-1 - far % size] if backward else u[far % size]):
                at, far = at + step, far + 1
            out.append((far, "done" if 0 <= at < len(x) else "more"))
        return pd.DataFrame(out, columns=["reach", "state"])

    key = ["contig", "pos", "ref", "alt"]
    left = indels.select(*key, F.when(F.col("ref") == "", F.col("alt")).otherwise(F.col("ref")).alias("unit"), F.lit(0).cast("long").alias("reach"))
    found, rounds = None, []
    while True:
        at = F.col("pos") - 1 - F.col("reach") if backward else F.col("pos") + F.length("ref") + F.col("reach")
        x = left.withColumn("_at", at).withColumn("tile", F.floor(F.col("_at") / width))
        y = x.join(tiles.select("contig", "tile", "letters"), ["contig", "tile"], "left")
        z = y.select(*key, "unit", follow("unit", "reach", (F.col("_at") - F.col("tile") * width), "letters").alias("f")).select(*key, "unit", "f.reach", "f.state")
        done = materialize(z, "repeats")
        rounds.append(done)
        ends = done.where("state <> 'more'").select(*key, F.when(F.col("state") == "done", F.col("reach")).alias("reach"))
        found = ends if found is None else found.unionByName(ends)
        left = done.where("state = 'more'").drop("state")
        if left.isEmpty():
            break
    out = materialize(found, "reach")
    for r in rounds:
        discard(r)
    return out
