"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Method. Numbers, names and units become typed placeholders, other words their lower-case
letters. Windows of five template words of the benchmark are hashed and joined with those
of the documents, so a question whose figures and names were changed still meets its
windows. In documents that share enough windows with an item, the slots of every
alignment are compared: within one alignment an item's value must always stand for
the same value of the document: where it stands for several, the commonest counts (of equally
common ones the same value as the item's), and windows that hold another are taken out. Where there is
no such one, all windows of that value are, and the others of that alignment count for the
share, not for a run. A document
is contaminated by an item if the windows of consistent alignments cover 0.8
of the item's, or if consecutive windows of one of them make up a run of at least ``run`` words.

Documents are first looked for by runs of letter words (three, else two or one) that an item's windows hold:
a bound by counting says how many of them any document with enough windows must hold, so no such document is
lost, and only the others are spared the two views. Items that hold too few such words have enough windows of placeholders alone;
for them documents are looked for that hold as many numbers, capitalised words or units in a row.

Each text has two views, and either may fulfil the rule: the template, and plain lower-case words, where
names stay words; so copies in other case or with other marks round a name are met too.
A run of plain words does not count where the template of that document has such a run whose
slots are left alone. Whatever conflicts elsewhere, a run of at least ``TORN_RUN`` words whose slots all hold the item's own values counts in either view. White space of any kind is one space.
Names are capitalised words after a word or a comma of the same sentence, also in quotes or brackets. Units are
those of a fixed list, as whole words. Defined cases: null or empty texts have no
windows. An item of fewer words than a window has one window, the whole of it; it is searched within
documents by windows of its own length. Items of less than ``shortest`` words, or of placeholders only,
meet only documents that are just those words, unless ``everywhere`` is asked for: then each item is searched within all texts, however short. Rows with the same identifier count as
one document; a null identifier is a document of its own. Rows of items are each
reported, whatever their identifiers; a null one too. Empty tables give no row. The benchmark's windows are broadcast if their
counted number is within ``BROADCAST_WINDOWS``, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import materialize

WINDOW = 5
#: Words of an item that is searched within other texts.
SHORTEST = 3
SHARE = 0.8
RUN = 13
#: Words of a verbatim run in an alignment whose slots conflict elsewhere: more than a run needs, for such an alignment tells against a copy.
TORN_RUN = 20
#: Letter words in a row by which documents are looked for first.
GRAMS = (3, 2, 1)
BROADCAST_WINDOWS = 500_000
BROADCAST_IDS = 1_000_000

UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal s sec min h hr hrs ms "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees watt watts volt volts"
).split()

_NUMBER, _NAME, _UNIT = "⟨n⟩", "⟨p⟩", "⟨u⟩"
#: Patterns begin with the letter or digit they are about, so that most places of a text are left at once.
_DIGITS = r"(\p{Nd}+(?:[.,:/]\p{Nd}+)*)"
_CAPITAL = r"(?=\p{Lu})(?<=[\p{L}\p{Nd},;] [\"'(\[“‘«]?)(\p{Lu}[\p{L}\p{Mn}'-]*)"
_UNIT_WORD = r"(\p{Nd} ?)(" + "|".join(UNITS) + r")\b"
#: White space other than a space between two words.
_SPACES = r"(?: (?=[\s\p{Z}])|[\s\p{Z}&&[^ ]])[\s\p{Z}]*"
#: What separates words of a template.
_APART = r"[^\p{L}\p{Mn}\p{Nd}⟨⟩]+"
_LETTERS_APART = r"[^\p{L}\p{Mn}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _APART), "")


def _canonical(text: Column, unit: str, name: str | None, number: str) -> Column:
    """Placeholders stand apart from what is around them, whatever they hold."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("⟨"), F.lit(" ")), F.lit("⟩"), F.lit(" "))
    t = F.regexp_replace(t, _SPACES, " ")
    t = F.regexp_replace(t, _UNIT_WORD, f"$1 {unit.replace('$1', '$2')} ")
    t = F.regexp_replace(t, _CAPITAL, f" {name} ") if name else t
    return F.regexp_replace(t, _DIGITS, f" {number} ")


def template_words(text: Column) -> Column:
    """Words of the canonical template of a text."""
    return _words(F.lower(_canonical(text, _UNIT, _NAME, _NUMBER)))


def slot_words(text: Column) -> Column:
    """The same words, where placeholders keep what they stand for, as marked text."""
    return _marked(_canonical(text, "⟨u$1⟩", "⟨p$1⟩", "⟨n$1⟩"))


def plain_words(text: Column) -> Column:
    """Lower-case words, where numbers and units are placeholders and names are not."""
    return _words(_canonical(F.lower(text), _UNIT, None, _NUMBER))


def plain_slot_words(text: Column) -> Column:
    return _marked(_canonical(F.lower(text), "⟨u$1⟩", None, "⟨n$1⟩"))


def views(text: Column) -> Column:
    """Structs of view (0 template, 1 plain), words and slots."""
    template = F.struct(F.lit(0).alias("view"), template_words(text).alias("words"), slot_words(text).alias("slots"))
    return F.array(template, F.struct(F.lit(1).alias("view"), plain_words(text).alias("words"), plain_slot_words(text).alias("slots")))


def _marked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(⟨[^⟩]*⟩|[\\p{L}\\p{Mn}\\p{Nd}]+)"), F.lit(1))


def window_hashes(words: Column, size: int = WINDOW) -> Column:
    """A hash for each window; the whole of shorter texts is one window; none without words."""
    n = F.size(words)
    last = F.greatest(n - size, F.lit(0))
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(n > 0, hashes).otherwise(F.array().cast("array<bigint>"))


def spread_hashes(rows: DataFrame, sizes: list[int], short: bool = True) -> DataFrame:
    """doc_id, h: a row for each hash that :func:`window_hashes` gives of ``words``, for every one of ``sizes``.

    Words are zipped with those after them, so hashes are made row by row in generated code.
    Without ``short``, texts of fewer words than a window have none of that size.
    """
    most = max(sizes)
    names = [f"w{k}" for k in range(most)]
    after = [F.col("words") if not k else F.slice("words", k + 1, F.greatest(F.size("words") - k, F.lit(0))) for k in range(most)]
    zipped = F.arrays_zip(*[a.alias(n) for a, n in zip(after, names, strict=True)])
    each = rows.select("doc_id", F.size("words").alias("n"), F.posexplode(zipped).alias("at", "z")).select("doc_id", "n", "at", *[F.col("z")[n].alias(n) for n in names])
    whole = lambda k: F.col(names[k - 1]).isNotNull() | ((F.col("at") == 0) & (F.col("n") < k) & F.lit(short))
    if len(sizes) == 1:
        return each.where(whole(most)).select("doc_id", F.xxhash64(*names).alias("h"))
    hashes = F.array(*[F.when(whole(k), F.xxhash64(*names[:k])) for k in sizes])
    return each.select("doc_id", F.explode(hashes).alias("h")).where("h is not null")


def letter_words(text: Column) -> Column:
    """Lower-case words of letters alone: consecutive words of either view that are no placeholders are so here too."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _LETTERS_APART), "")


def cores(bench: DataFrame, totals: DataFrame) -> DataFrame:
    """item, view, gram, need, h: runs of ``gram`` letter words of which a document must hold ``need`` to have enough windows.

    A window without such a run tells nothing here; if there are as many of those as windows that are enough,
    shorter runs are tried. ``gram`` and ``h`` are null where single words do not do either.
    """
    def runs(g: int) -> Column:
        letters = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda k: (k + g <= F.size("words")) & F.forall(F.slice("words", k + 1, g), lambda w: ~w.startswith("⟨")))
        return F.struct(F.lit(g).alias("gram"), F.transform(letters, lambda k: F.xxhash64(*[F.get("words", k + i) for i in range(g)])).alias("runs"))

    by = ["item", "view", "gram"]
    held = bench.select("item", "view", "h", F.explode(F.array(*[runs(g) for g in GRAMS])).alias("x")).select("item", "view", "h", "x.*")
    each = held.select(*by, "h", F.explode_outer("runs").alias("r")).groupBy(*by, "r").agg(F.countDistinct("h").alias("n"))
    told = each.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("r").isNull(), F.col("n"))), F.lit(0)).alias("mute"), F.max(F.when(F.col("r").isNotNull(), F.col("n"))).alias("often"), F.collect_set("r").alias("rs"))
    fits = (F.col("mute") < F.col("enough")) & F.col("often").isNotNull()
    need = F.ceil((F.col("enough") - F.col("mute")) / F.col("often")).alias("need")
    best = told.join(totals.select("item", "view", "enough"), ["item", "view"]).groupBy("item", "view").agg(F.max(F.when(fits, F.struct("gram", need, "rs"))).alias("x"))
    return best.select("item", "view", F.col("x")["gram"].alias("gram"), F.col("x")["need"].alias("need"), F.explode_outer(F.col("x")["rs"]).alias("h"))


def benchmark_windows(known: DataFrame, run: int = RUN, shortest: int = SHORTEST, everywhere: bool = False) -> DataFrame:
    """A row a window of ``known`` (item, text): item, view, n_words, within, fewest (distinct windows that a run of ``run`` words may hold), item_at, h, item_slots, words."""
    words = known.select("item", F.explode(views(F.col("text"))).alias("v")).select("item", "v.*")
    hashed = words.select("item", "view", F.size("words").alias("n_words"), _within(F.col("words"), shortest, everywhere).alias("within"), "slots", "words", window_hashes(F.col("words")).alias("hs"))
    spread = hashed.select("item", "view", "n_words", "within", "slots", "words", _fewest(F.col("hs"), run).alias("fewest"), F.posexplode("hs").alias("item_at", "h"))
    return spread.withColumn("slots", F.slice("slots", F.col("item_at") + 1, WINDOW)).withColumn("words", F.slice("words", F.col("item_at") + 1, WINDOW)).withColumnRenamed("slots", "item_slots")


def _within(words: Column, shortest: int, everywhere: bool) -> Column:
    """Whether a text shorter than a window is searched within others: by a window of its own length."""
    if everywhere:
        return F.size(words).between(1, WINDOW - 1)
    return F.size(words).between(shortest, WINDOW - 1) & F.exists(words, lambda w: ~w.startswith("⟨"))


def placeholders_in_a_row(text: Column, n: int) -> Column:
    """Whether a text may hold ``n`` placeholders in a row, in either view: as many numbers, words with a capital, or units follow each other."""
    token = r"(?:\p{Nd}++(?:[.,:/]\p{Nd}++)*+|\p{Lu}[\p{L}\p{Mn}'-]*+|(?i:" + "|".join(UNITS) + r")(?![\p{L}\p{Mn}]))"
    return F.coalesce(text, F.lit("")).rlike(r"(?:" + token + r"[^\p{L}\p{Mn}\p{Nd}]*+){" + str(n) + "}")


def _windows_of(run: int) -> int:
    return max(1, run - WINDOW + 1)


def _fewest(hashes: Column, run: int) -> Column:
    n = _windows_of(run)
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - n, F.lit(0)))
    return F.array_min(F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(hashes, i + 1, n)))))


def judged(hits: DataFrame) -> DataFrame:
    """A row an alignment (doc_id, row, item, view, along): hs, longest run of windows, that of windows whose slots are the item's own, changed slots.

    ``hits``: a row a window met, with its ``pairs`` of slots (item_slots, doc_slots, at).
    """
    line = ["doc_id", "row", "item", "view", "along"]
    each = hits.repartition(*line).select(*line, "item_at", "h", F.explode_outer("pairs").alias("z"))
    each = each.select(*line, "item_at", "h", F.col("z")["item_slots"].alias("value"), F.col("z")["doc_slots"].alias("other"), F.col("z")["at"].alias("at"))
    pair, value = Window.partitionBy(*line, "value", "other"), Window.partitionBy(*line, "value")
    by_place = pair.orderBy("at")
    each = each.withColumn("place", F.dense_rank().over(by_place)).withColumn("new", (F.row_number().over(by_place) == 1) & (F.col("value") != F.col("other")))
    each = each.withColumn("rank", F.struct(F.max("place").over(pair).alias("times"), (F.col("value") == F.col("other")).alias("same")))
    each = each.withColumn("top", F.when(F.col("rank") == F.max("rank").over(value), F.col("other")))
    each = each.withColumn("low", F.min("top").over(value)).withColumn("torn", F.coalesce(F.col("low") != F.max("top").over(value), F.lit(False)))
    each = each.withColumn("off", F.coalesce(F.col("torn") | (F.col("other") != F.col("low")), F.lit(False)))
    windows = each.groupBy(*line, "item_at", "h").agg(F.max("off").alias("off"), F.max("torn").alias("torn"), F.sum((F.col("new") & ~F.col("off")).cast("int")).alias("new"), F.coalesce(F.max(F.col("value") != F.col("other")), F.lit(False)).alias("differs"))
    own = windows.where(~F.col("differs")).withColumn("island", F.col("item_at") - F.dense_rank().over(Window.partitionBy(*line).orderBy("item_at")))
    own = own.groupBy(*line, "island").agg(F.countDistinct("item_at").alias("own_run")).groupBy(*line).agg(F.max("own_run").alias("own_run"))
    windows = windows.withColumn("torn", F.max("torn").over(Window.partitionBy(*line))).where(~F.col("off"))
    windows = windows.withColumn("island", F.col("item_at") - F.dense_rank().over(Window.partitionBy(*line).orderBy("item_at")))
    islands = windows.groupBy(*line, "island").agg(F.count(F.lit(1)).alias("run"), F.collect_set("h").alias("hs"), F.max("torn").alias("torn"), F.sum("new").alias("new"))
    out = islands.groupBy(*line).agg(F.flatten(F.collect_list("hs")).alias("hs"), F.max("run").alias("run"), F.max("torn").alias("torn"), F.coalesce(F.sum("new"), F.lit(0)).cast("int").alias("changed"))
    same = out["doc_id"].eqNullSafe(own["doc_id"])
    for c in line[1:]:
        same = same & (out[c] == own[c])
    return out.join(own, same, "left").select(*[out[c] for c in out.columns], F.coalesce("own_run", F.lit(0)).alias("own_run"))


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is among ``ids``, null included."""
    ids = ids.toDF("_id")
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, rows["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", share: float = SHARE, run: int = RUN, shortest: int = SHORTEST, everywhere: bool = False) -> DataFrame:
    """A row a contaminated document and item: doc_id, item_id, windows, matched, share, changed_slots.

    ``everywhere`` searches items of any length, also of figures alone, within all texts; it costs a row a word, and many texts hold a short item by chance.
    """
    known = materialize(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")), "known")
    bench = materialize(benchmark_windows(known, run, shortest, everywhere), "benchmark")
    n_bench = bench.count()
    small = n_bench <= BROADCAST_WINDOWS
    hint = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    totals = bench.groupBy("item", "view").agg(F.countDistinct("h").alias("windows"), F.max("n_words").alias("n_words"), F.max("fewest").alias("fewest"))
    totals = totals.withColumn("covering", F.greatest(F.ceil(F.col("windows") * share), F.lit(1)).cast("long"))
    # A run needs as many windows; where windows repeat, fewer distinct ones.
    has_run = F.col("n_words") - WINDOW + 1 >= _windows_of(run)
    totals = materialize(totals.withColumn("enough", F.when(has_run, F.least("covering", "fewest")).otherwise(F.col("covering"))), "items")
    sizes = [WINDOW, *(r[0] for r in bench.where("within").select("n_words").distinct().collect())]

    # Documents without enough of some item's letter words in a row are not read into views.
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    core = materialize(cores(bench, totals), "cores")
    grams = sorted(r[0] for r in core.where("gram is not null").select("gram").distinct().collect())
    mute = core.where("gram is null").select("item").distinct()
    fewest = mute.join(bench, "item").agg(F.min(F.least("n_words", F.lit(WINDOW)))).first()[0]
    found = [rows.where(placeholders_in_a_row(F.col("text"), fewest)).select("doc_id")] if fewest else []
    if grams:
        held = spread_hashes(rows.select("doc_id", letter_words(F.col("text")).alias("words")), grams, False).join(hint(core.where("gram is not null")), "h")
        held = held.groupBy("doc_id", "item", "view", "need").agg(F.countDistinct("h").alias("held")).where("held >= need")
        found.append(held.select("doc_id"))
    likely = rows
    if found:
        ids = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        likely = _of(rows, materialize(ids.distinct(), "likely"))

    # Windows without names are the same in both views.
    both = likely.select("doc_id", template_words(F.col("text")).alias("words"), plain_words(F.col("text")).alias("plain"))
    none = F.array().cast("array<string>")
    each = F.explode(F.array("words", F.when(F.col("plain") != F.col("words"), F.col("plain")).otherwise(none))).alias("words")
    spread = spread_hashes(both.select("doc_id", each), sizes)
    keys = bench.select("h", "item", "view").distinct()
    met = spread.join(hint(keys), "h").groupBy("doc_id", "item", "view").agg(F.countDistinct("h").alias("met"))
    first = materialize(met.join(hint(totals), ["item", "view"]).where("met >= enough").select("doc_id", "item").distinct(), "candidates")

    # Only candidates are read again, with places and slot values.
    few = first.count() <= BROADCAST_IDS
    again = _of(rows, first.select("doc_id").distinct())
    again = again.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    again = again.select("doc_id", "row", F.explode(views(F.col("text"))).alias("v")).select("doc_id", "row", "v.*")
    by_size = F.explode(F.array(*[window_hashes(F.col("words"), k) for k in sizes])).alias("hs")
    placed = again.select("doc_id", "row", "view", "slots", F.size("words").alias("n"), by_size).select("doc_id", "row", "view", "slots", "n", F.posexplode("hs").alias("doc_at", "h"))
    placed = placed.select("doc_id", "row", "view", "n", "doc_at", "h", F.slice("slots", F.col("doc_at") + 1, WINDOW).alias("doc_slots"))
    hits = placed.join(hint(bench.drop("words")), ["h", "view"]).withColumn("along", F.col("doc_at") - F.col("item_at"))
    hits = hits.where((F.col("n_words") >= WINDOW) | F.col("within") | (F.col("n") == F.col("n_words")))
    pairs = first.toDF("d", "i")
    hits = hits.join(F.broadcast(pairs) if few else pairs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("item") == F.col("i")), "left_semi")
    places_of = F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.col("item_at") + k)
    slot_pairs = F.filter(F.arrays_zip("item_slots", "doc_slots", F.slice(places_of, 1, F.size("item_slots")).alias("at")), lambda z: z["item_slots"].startswith("⟨"))
    lines = judged(hits.select("doc_id", "row", "item", "view", "along", "item_at", "h", slot_pairs.alias("pairs")))
    left = (F.col("view") == 0) & F.col("torn") & (F.col("run") >= _windows_of(run))
    lines = lines.withColumn("left", F.max(left).over(Window.partitionBy("doc_id", "row", "item")))
    counts = ~F.col("torn") & ((F.col("view") == 0) | ~F.col("left"))
    covered = lines.groupBy("doc_id", "item", "view").agg(F.array_distinct(F.flatten(F.collect_list("hs"))).alias("hs"), F.max(F.when(counts, F.col("run"))).alias("run"), F.max("own_run").alias("own_run"), F.max("changed").alias("changed_slots"))
    whole = (F.col("matched") >= F.col("covering")) | (F.coalesce("run", F.lit(0)) >= _windows_of(run)) | (F.col("own_run") >= _windows_of(max(run, TORN_RUN)))
    out = covered.withColumn("matched", F.size("hs").cast("long")).join(hint(totals), ["item", "view"]).where(whole).withColumn("share", F.col("matched") / F.col("windows"))
    best = out.groupBy("doc_id", "item").agg(F.max_by(F.struct("windows", "matched", "share", "changed_slots"), F.struct("share", -F.col("view"))).alias("x"))
    return best.join(hint(known.select("item", "item_id")), "item").select("doc_id", "item_id", "x.*")


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the contaminated documents."""
    found = materialize(contaminated(docs, items, text, doc_id, **options).select(F.col("doc_id").alias("_found")).distinct(), "contaminated")
    few = found.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(found) if few else found, docs[doc_id].eqNullSafe(found["_found"]), "left_anti")
