import pytest

from strandlake.session import write_text
from strandlake.sources import store

BASES = "mod_base string, can_base string, long_name string"
ROWS = [("chr1", p, s, f"r{i}", m, -0.1 * (i + 1)) for p in (0, 5, 99) for s in (1, -1) for i in range(3) for m in "hm"]
NAMES = ["chrm", "pos", "strand", "read_id", "mod_base", "score"]


@pytest.fixture
def parts(spark):
    return spark.createDataFrame([("chr1", 100), ("chr2", 50)], "chrm string, chrm_len long"), spark.createDataFrame([("m", "C", "5mC"), ("h", "C", "5hmC")], BASES)


def mods(spark, path, parts):
    return store.create(spark, str(path), "mods", *parts)


def test_rows_are_added_found_and_listed(spark, parts, tmp_path):
    s = mods(spark, tmp_path / "a", parts)
    assert s.calls.count() == 0 and s.alphabet() == ["h", "m"]
    s = store.add(s, spark.createDataFrame(ROWS[:20], NAMES))
    s = store.add(s, spark.createDataFrame(ROWS[20:], NAMES))
    again = store.open_store(spark, str(tmp_path / "a"), "mods")
    assert sorted(map(tuple, again.calls.collect())) == sorted(ROWS)
    assert sorted(map(tuple, again.within("chr1", 5, 99).collect())) == sorted(r for r in ROWS if r[1] == 5)
    assert sorted(map(tuple, again.at("chr1", 0, -1).collect())) == sorted(r for r in ROWS if r[1:3] == (0, -1))
    assert {(r["pos"], r["strand"], r["n"], r["reads"]) for r in again.sites().collect()} == {(p, x, 6, 3) for p in (0, 5, 99) for x in (1, -1)}
    assert again.reads().count() == 3
    plan = again.within("chr1", 5, 99)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(pos,5)" in plan and "EqualTo(chrm,chr1)" in plan


def test_rows_that_do_not_belong_are_refused_whole(spark, parts, tmp_path):
    s = mods(spark, tmp_path / "a", parts)
    for bad in (("chr9", 1, 1, "r", "m", -1.0), ("chr2", 50, 1, "r", "m", -1.0), ("chr1", -1, 1, "r", "m", -1.0), ("chr1", 1, 1, "r", "x", -1.0), ("chr1", 1, 1, "r", "m", None), ("chr1", 1, 1, "r", "m", 0.5)):
        with pytest.raises(store.StoreError, match="1 "):
            store.add(s, spark.createDataFrame([*ROWS, bad], "chrm string, pos long, strand int, read_id string, mod_base string, score double"))
    with pytest.raises(store.StoreError, match="lack"):
        store.add(s, spark.createDataFrame(ROWS, NAMES).drop("strand"))
    assert store.open_store(spark, str(tmp_path / "a"), "mods").calls.count() == 0


def test_foreign_half_written_and_changed_folders_are_refused(spark, parts, tmp_path):
    with pytest.raises(store.StoreError):
        store.open_store(spark, str(tmp_path / "none"), "mods")
    s = store.add(mods(spark, tmp_path / "a", parts), spark.createDataFrame(ROWS, NAMES))
    with pytest.raises(store.StoreError):
        store.open_store(spark, s.path, "variants")
    with pytest.raises(store.StoreError):
        mods(spark, tmp_path / "a", parts)
    # Rows without a manifest, as a writer leaves them that stopped, are not there.
    spark.createDataFrame(ROWS, NAMES).write.parquet(f"{s.path}/data/unfinished")
    assert store.open_store(spark, s.path, "mods").calls.count() == len(ROWS)
    # Two writers at once: the second's commit is refused.
    with pytest.raises(FileExistsError):
        store.add(mods_view(s), spark.createDataFrame(ROWS[:2], NAMES))
    spark.createDataFrame(ROWS, NAMES).drop("strand").write.mode("overwrite").parquet(f"{s.path}/data/{s.manifests[1]['commit']}")
    with pytest.raises(store.StoreError, match="other columns"):
        store.open_store(spark, s.path, "mods")
    for name, text in (("odd", "no json"), ("list", "[1]"), ("version", '{"number": 0, "format": 99, "kind": "mods"}')):
        write_text(spark, f"{tmp_path}/{name}/manifests/0.json", text)
        with pytest.raises(store.StoreError):
            store.open_store(spark, str(tmp_path / name), "mods")
    (tmp_path / "a" / "manifests" / "00000000.json").unlink()
    with pytest.raises(store.StoreError, match="lacks"):
        store.open_store(spark, s.path, "mods")


def mods_view(s):
    """The store as a writer saw it before the last commit."""
    return store.Store(s.spark, s.path, s.kind, s.manifests[:-1])


def test_merging_checks_contigs_and_bases(spark, parts, tmp_path):
    a = store.add(mods(spark, tmp_path / "a", parts), spark.createDataFrame(ROWS, NAMES))
    more = [(*r[:5], r[5] - 1) for r in ROWS[:5]] + [("chr2", 3, 1, "q", "m", -2.0)]
    b = store.add(mods(spark, tmp_path / "b", parts), spark.createDataFrame(more, NAMES))
    assert sorted(map(tuple, store.merge([a, b], str(tmp_path / "ab")).calls.collect())) == sorted([*ROWS, more[-1]])
    c = mods(spark, tmp_path / "c", (spark.createDataFrame([("chr1", 101)], "chrm string, chrm_len long"), parts[1]))
    d = mods(spark, tmp_path / "d", (parts[0], spark.createDataFrame([("m", "A", "6mA")], BASES)))
    for other, text in ((c, "lengths"), (d, "canonical")):
        with pytest.raises(store.StoreError, match=text):
            store.merge([a, other], str(tmp_path / f"x{text}"))


def test_variants_have_a_store_too(spark, parts, tmp_path):
    s = store.create(spark, str(tmp_path / "v"), "variants", parts[0])
    rows = [("chr1", 4, 5, "A", "G", "rs1", "r1", 1, -0.5), ("chr1", 4, 5, "A", "T", "rs1", "r1", 1, -1.5)]
    s = store.add(s, spark.createDataFrame(rows, [f.name for f in store._schema("variants")]))
    assert sorted(map(tuple, s.at("chr1", 4).collect())) == rows
    with pytest.raises(store.StoreError):
        store.create(spark, str(tmp_path / "w"), "variants", *parts)
    with pytest.raises(store.StoreError):
        store.create(spark, str(tmp_path / "w"), "reads", parts[0])


def test_added_rows_are_worked_out_once(spark, parts, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    made = mods(spark, str(tmp_path / "s"), parts)
    rows = spark.range(20).selectExpr("'chr1' as chrm", "id % 5 as pos", "1 as strand", "cast(id as string) as read_id", "'m' as mod_base", "-1.0D as score")
    full = store.add(made, rows.mapInArrow(count, rows.schema))
    assert seen.value == 20 and full.calls.count() == 20
