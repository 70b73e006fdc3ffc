from pyspark.sql import functions as F

from strandlake.llm import decontaminate as dc
from tests_llm_prose import prose

ITEM = "A train leaves London with Alice at 40 km per hour and returns after 3 hours carrying 25 kg of tea, while Alice reads 12 letters from her aunt."


def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, prose(900, 40)), (3, "two words"), (4, None), (5, "")], "item_id long, text string")


def found(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in dc.contaminated(df, items(spark)).collect()}


def test_verbatim_and_changed_questions_are_caught(spark):
    filler = prose(31, 80)
    other = ITEM.replace("40", "75").replace("Alice", "Bob").replace("25", "8").replace("12", "99")
    out = found(spark, [filler, f"{filler} {ITEM} {filler}", f"{filler}\n{other}", None, "", ITEM.upper(), "two words", "more than two words here"])
    assert set(out) == {(1, 1), (2, 1), (6, 3)} | ({(5, 1)} & set(out))
    assert out[2, 1]["changed_slots"] >= 4 and out[1, 1]["changed_slots"] == 0


def test_inconsistent_slots_are_left_alone(spark):
    # The same name must stand for the same name throughout an alignment.
    mixed = ITEM.replace("with Alice", "with Bob").replace("while Alice", "while Carol")
    assert (0, 1) not in found(spark, [mixed])
    assert (0, 1) in found(spark, [ITEM.replace("with Alice", "with Bob").replace("while Alice", "while Bob")])


def test_template_and_slots_are_aligned(spark):
    texts = ["He paid 3.5kg, then 1,200 euros to Anna-Marie O'Neil at 10:30.", "x3 y 4th ⟨odd⟩ New York, Paris", "Mixed 5 km 7kg days", "", "Ça va, Éric? 12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(dc.template_words(F.col("t")).alias("a"), dc.slot_words(F.col("t")).alias("b")).collect():
        assert len(r["a"]) == len(r["b"])
        for x, y in zip(r["a"], r["b"], strict=True):
            assert (x == y.lower()) if not x.startswith("⟨") else y.startswith(x[:2])
    assert df.select(dc.template_words(F.col("t")).alias("a")).first()["a"] == ["he", "paid", "⟨n⟩", "⟨u⟩", "then", "⟨n⟩", "⟨u⟩", "to", "⟨p⟩", "⟨p⟩", "at", "⟨n⟩"]


def test_matches_brute_force_on_plain_words(spark):
    def windows(t):
        w = "".join(c.lower() if c.isalnum() else " " for c in (t or "")).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    plain = lambda s, n: "".join(c for c in prose(s, n) if not c.isdigit()).lower().replace(",", " ")
    bench = [(i, plain(500 + i, 30)) for i in range(6)]
    texts = [plain(i, 60) for i in range(20)]
    for i in range(6):
        w = bench[i][1].split()
        texts[3 * i] += " " + " ".join(w[: 5 + 5 * i])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = set()
    for d, t in enumerate(texts):
        for i, b in bench:
            hit = len(windows(t) & windows(b))
            if hit >= min(-(-8 * len(windows(b)) // 10), 9):
                want.add((d, i))
    assert out == want and len(want) >= 3


def test_shuffle_path_equals_broadcast_path(spark, monkeypatch):
    texts = [f"{prose(3, 30)} {ITEM}", prose(4, 50)]
    a = set(found(spark, texts))
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(dc, "BROADCAST_IDS", 0)
    assert set(found(spark, texts)) == a == {(0, 1)}


def test_null_ids_repeats_extra_columns_and_empty_tables(spark, docs, empty):
    df = spark.createDataFrame([(None, ITEM, "h"), (3, ITEM, "h"), (3, ITEM, "h"), (4, prose(1, 30), "h")], "doc_id long, text string, h string")
    kept = dc.remove_contaminated(df, items(spark))
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [4]
    assert {r["doc_id"] for r in dc.contaminated(df, items(spark)).collect()} == {None, 3}
    assert dc.contaminated(empty, items(spark)).count() == 0
    assert dc.contaminated(docs, items(spark).limit(0)).count() == 0
    assert dc.remove_contaminated(docs, items(spark).limit(0)).count() == docs.count()


def test_a_run_is_of_consecutive_windows(spark):
    words = prose(77, 300).replace("\n", " ").split()
    pieces = [" ".join(words[at : at + 5]) for at in range(250, 0, -20)]
    scattered = " xx yy ".join(pieces)
    run = "xx yy " + " ".join(words[100:120]) + " zz"
    same = "go " * 40
    df = spark.createDataFrame([(0, scattered), (1, run), (2, f"well {'go ' * 14} on"), (3, "go go go go go on")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words)), (2, f"{same} {prose(901, 60)}")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench).collect()} == {(1, 1), (2, 2)}


def test_one_changed_slot_takes_out_only_its_windows(spark):
    assert (0, 1) in found(spark, [ITEM.replace("while Alice", "while Alicia")])
    long = f"we met Alice there {prose(902, 120)} and then Alice went home"
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    df = spark.createDataFrame([(0, long.replace("met Alice", "met Bob").replace("then Alice", "then Carol"))], "doc_id long, text string")
    row = dc.contaminated(df, bench).first()
    assert row is not None and 0.8 <= row["share"] < 1


def test_copies_in_other_case_or_spacing_are_caught(spark):
    filler = prose(31, 80)
    spaced = ITEM.replace(" Alice", "\n  Alice").replace(" London", ' "London"')
    texts = [ITEM.upper(), f"{filler} {ITEM.lower()} {filler}", f"{filler} {ITEM.title()}", spaced, filler.upper()]
    assert set(found(spark, texts)) == {(0, 1), (1, 1), (2, 1), (3, 1)}


def test_short_items_repeated_and_null_identifiers(spark):
    bench = spark.createDataFrame([(1, "What is 17 * 23?"), (2, prose(910, 40)), (2, prose(911, 30)), (None, prose(912, 40)), (None, prose(913, 40)), (5, "12 34 56"), (6, "two words")], "item_id long, text string")
    texts = [f"{prose(920, 30)} What is 17 * 23? {prose(921, 30)}", prose(910, 40), prose(911, 30), prose(912, 40), prose(913, 40), f"{prose(922, 30)} 1 2 3 two words", "7 8 9", "two words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"] or 0) for r in dc.contaminated(df, bench).collect())
    assert got == [(0, 1), (1, 2), (2, 2), (3, 0), (4, 0), (6, 5), (7, 6)]


def test_a_long_verbatim_run_counts_where_slots_conflict_elsewhere(spark):
    body = " ".join(w for w in prose(930, 120).replace("\n", " ").split() if not any(c.isdigit() for c in w) and w.isalpha() and w.islower())[:170]
    item = f"there were 5 of them {body} and then 5 more {prose(931, 90)}"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    passage = f"there were 7 of them {body} and then 9 more"
    assert len(body.split()) >= 20
    df = spark.createDataFrame([(0, f"{prose(932, 30)} {passage} {prose(933, 30)}"), (1, prose(934, 60))], "doc_id long, text string")
    assert [r["doc_id"] for r in dc.contaminated(df, bench).collect()] == [0]


def test_short_items_are_searched_everywhere_on_demand(spark):
    bench = spark.createDataFrame([(1, "zebra crossings"), (2, "12 34 56"), (3, "quagga")], "item_id long, text string")
    texts = [f"{prose(940, 20)} Zebra crossings {prose(941, 20)}", "he said 7, 8, 9 to her", "a quagga here", "zebra and crossings", "zebra crossings", "one 5 two 6"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench).collect()) == [(4, 1)]
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench, everywhere=True).collect()) == [(0, 1), (1, 2), (2, 3), (4, 1)]


def test_documents_that_are_looked_for_first_are_all_that_count(spark, monkeypatch):
    bench = [(1, ITEM), (2, prose(950, 40)), (3, "12 34 56"), (4, "5 km, 7 kg; Paris 8 Rome 9 London 3 h"), (5, "2 + 2"), (6, "Anna Maria Otto Carl Dora Emil 7")]
    texts = [f"{prose(i, 20)} {t} {prose(i + 1, 20)}" for i, (_, t) in enumerate(bench)] + [t for _, t in bench] + [prose(960 + i, 50) for i in range(5)]
    texts += ["so 6 km, 1 kg; Oslo 3 Bern 2 Athens 4 h it is", "we saw 6 km, 1 kg; oslo 3 bern 2", "1 2 3", "1 KM 2", "9 + 9", None, "", "he met, Bert Clara Doris Eve Fred Gina 9"]
    df, items_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    with_search = sorted((r["doc_id"], r["item_id"]) for r in dc.contaminated(df, items_).collect())
    monkeypatch.setattr(dc, "placeholders_in_a_row", lambda text, n: F.lit(True))
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.contaminated(df, items_).collect()) == with_search and len(with_search) >= 9


def test_very_long_texts(spark):
    df = spark.createDataFrame([(0, f"{prose(970, 20000)} {ITEM} {prose(971, 20000)}"), (1, "x" * 300_000), (2, "7 " * 50_000)], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in dc.contaminated(df, items(spark)).collect()] == [(0, 1)]
