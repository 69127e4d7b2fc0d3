"""Line deduplication by a log-template tree, in DataFrame functions only.

A line is masked (words with digits become a wildcard) and parsed to a leaf of a tree of fixed depth: its number of
tokens, then its DEPTH leading tokens. Within a leaf, a token that stands at its position in `min_docs` lines or more is
constant there, others are fields: they generalise to wildcards. Lines of one leaf with the same constants follow one
template, so a leaf has as many templates as it mixes kinds of lines. A template counts if at least FIXED of its
positions are constant. Templates that stand in `min_docs` documents or more recur, and their lines are dropped.

A document of which recurring lines hold more than MOST_DROPPED of the words may be a copy rather than a text with
boilerplate, and documents as wholes are for near-duplicate detection to judge. For these documents templates are
counted again, with a group of copies as one document, and only lines of templates that still recur are dropped. Copies
are found among these documents' distinct texts: texts that share one of COPY_MINIMA minimum hashes of their word
shingles are held against the least of them, and are its copies if their shingle sets have a similarity of COPY.

Texts are parsed once, and their lines written. Templates are made on distinct masked lines, each with the number of its
documents, so a line in a third of all documents is one row there; it meets its occurrences in a join of its own, which
Spark splits where it is skewed.

Defined cases: null text stays null; an empty text stays empty; lines without words always stay, and so do lines of
wildcards alone; repeated rows each lose the same lines and count as one document; rows of one id with different texts
are judged each by itself but count as one document, and so do all rows without an id; all other columns pass unchanged,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, Shared, tune

DEPTH = 3
MIN_DOCS = 10
FIXED = 0.7
MOST_DROPPED = 0.5
SHINGLE, COPY_MINIMA, COPY = 5, 8, 0.7
WILDCARD = "<*>"


def _tokens(line: Column) -> Column:
    """Masked tokens."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, f"{NOT_SPACE}*[0-9]{NOT_SPACE}*", WILDCARD)).otherwise(line)
    return F.array_remove(F.split(masked, SPACE + "+"), "")


def _lines(docs: DataFrame) -> DataFrame:
    """_row, _id, _all (words of the text), _line (its number), _n, _leaf, _full, _masked of every line with words."""
    rows = docs.select("_row", "_id", F.regexp_count("_text", F.lit(NOT_SPACE + "+")).alias("_all"), F.col("_text").alias("_doc"))
    # the projection above runs once for a text, one beside the generator would run for each of its lines
    rows = rows.select("_row", "_id", "_all", F.posexplode(F.split("_doc", "\n")).alias("_line", "_text"))
    rows = rows.select("_row", "_id", "_all", "_line", _tokens(F.col("_text")).alias("_tokens")).withColumn("_n", F.size("_tokens")).filter("_n > 0")
    rows = rows.withColumns({"_leaf": F.xxhash64("_n", F.slice("_tokens", 1, DEPTH)), "_masked": F.array_join("_tokens", " ")})  # a string moves in a fifth of the bytes
    return rows.drop("_tokens").withColumn("_full", F.xxhash64("_masked"))


def _recurring(docs: DataFrame, min_docs: int, shared: Shared) -> tuple[DataFrame, DataFrame]:
    """_row, _id, _line, _n, _template of every line of a recurring template; _row, _all of every text."""
    lines = shared.write(_lines(docs), "lines")
    one = ["_leaf", "_full"]
    by_doc = lines.groupBy(*one, "_id").agg(F.count(F.lit(1)).alias("_c"))
    docs_of = shared.write(by_doc.groupBy(*one).agg(F.count(F.lit(1)).alias("_docs")), "docs")
    # distinct lines of leaves that could hold a recurring template, with their tokens
    leaves = shared.write(docs_of.groupBy("_leaf").agg(F.sum("_docs").alias("_sum")).filter(F.col("_sum") >= min_docs).select("_leaf"), "leaves")
    open_ = shared.write(docs_of.join(leaves.hint("merge"), "_leaf", "left_semi"), "open")
    some = shared.write(lines.select(*one, "_masked").join(leaves.hint("merge"), "_leaf", "left_semi"), "some")  # written, so that Spark can split a hot leaf
    # a line that recurs as it stands brings its tokens once from each task
    distinct = some.groupBy(*one).agg(F.first("_masked").alias("_masked")).join(open_.hint("merge"), one)
    distinct = shared.write(distinct.withColumn("_tokens", F.split("_masked", " ")).drop("_masked"), "distinct")
    shared.release()
    tokens = distinct.select(*one, "_docs", F.posexplode("_tokens").alias("_pos", "_token"))
    often = tokens.groupBy("_leaf", "_pos", "_token").agg(F.sum("_docs").alias("_sum")).filter(F.col("_sum") >= min_docs).select("_leaf", "_pos", "_token")
    often = shared.write(often, "often")
    constants = tokens.drop("_docs").join(often, ["_leaf", "_pos", "_token"])
    constants = constants.groupBy(*one).agg(F.expr("bit_xor(xxhash64(_pos, _token))").alias("_template"), F.count_if(F.col("_token") != WILDCARD).alias("_fixed"))
    made = distinct.select(*one, "_docs", F.size("_tokens").alias("_n")).join(constants, one)
    made = made.filter((F.col("_fixed") >= FIXED * F.col("_n")) | ((F.col("_docs") >= min_docs) & (F.col("_fixed") > 0)))
    made = shared.write(made.select(*one, "_docs", F.xxhash64("_leaf", "_template").alias("_template")), "made")
    # a template with a line that recurs by itself does; of others, each line stands in few documents, which are counted
    sure = made.filter(F.col("_docs") >= min_docs).select("_template").distinct()
    rest = made.join(sure, "_template", "left_anti").select(*one, "_template")
    few = shared.write(by_doc.join(rest, one).select("_template", "_id").distinct(), "few")
    counted = few.groupBy("_template").agg(F.count(F.lit(1)).alias("_docs")).filter(F.col("_docs") >= min_docs).select("_template")
    wanted = shared.write(made.join(sure.unionByName(counted), "_template", "left_semi").select(*one, "_template"), "wanted")
    found = lines.select("_row", "_id", "_line", "_n", *one).join(wanted.hint("merge"), one).select("_row", "_id", "_line", "_n", "_template")
    return found, lines.groupBy("_row").agg(F.first("_all").alias("_all"))


def _copies(texts: DataFrame, shared: Shared) -> DataFrame:
    """_key, _root: of the texts (_key, _text), those that aren't the least of their group of copies."""
    words = F.filter(F.split(F.lower("_text"), SPACE + "+"), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - SHINGLE + 1, F.lit(1)))
    sets = texts.select("_key", words.alias("_w")).select("_key", F.array_distinct(F.transform(starts, lambda k: F.xxhash64(F.slice("_w", k, SHINGLE)))).alias("_set"))
    sets = shared.write(sets, "sets")
    minima = F.array(*[F.array_min(F.transform("_set", lambda x, k=k: F.xxhash64(x, F.lit(k)))) for k in range(COPY_MINIMA)])
    buckets = sets.select("_key", F.posexplode(minima).alias("_k", "_bucket"))
    hubs = buckets.groupBy("_k", "_bucket").agg(F.min("_key").alias("_hub"))
    pairs = buckets.join(hubs, ["_k", "_bucket"]).filter("_hub < _key").select("_key", "_hub").distinct()
    both = pairs.join(sets, "_key").join(sets.select(F.col("_key").alias("_hub"), F.col("_set").alias("_other")), "_hub")
    shared_ = F.size(F.array_intersect("_set", "_other"))
    links = both.filter(shared_ >= COPY * (F.size("_set") + F.size("_other") - shared_)).groupBy("_key").agg(F.min("_hub").alias("_root"))
    links = shared.write(links, "copies")
    further = links.select(F.col("_key").alias("_root"), F.col("_root").alias("_next"))
    return links.join(further, "_root", "left").select("_key", F.coalesce("_next", "_root").alias("_root"))


def _judged(found: DataFrame, totals: DataFrame, docs: DataFrame, min_docs: int, shared: Shared) -> DataFrame:
    """_row, _line to drop: in texts that mostly recur, only lines that recur with copies counted once."""
    words = found.groupBy("_row").agg(F.sum("_n").alias("_words"))
    mostly = shared.write(words.join(totals, "_row").filter(F.col("_words") > MOST_DROPPED * F.col("_all")).select("_row"), "mostly")
    texts = docs.select("_row", "_text").join(mostly, "_row", "left_semi")
    texts = shared.write(texts.select("_row", F.xxhash64("_text").alias("_key"), "_text"), "texts")
    roots = _copies(texts.select("_key", "_text").dropDuplicates(["_key"]), shared)
    roots = texts.select("_row", "_key").join(roots, "_key", "left").select("_row", F.coalesce("_root", "_key").alias("_root"))
    placed = shared.write(found.join(roots, "_row", "left"), "placed")
    # a group of copies is one unit, any other document one for its id
    unit = F.when(F.col("_root").isNotNull(), F.struct(F.lit(True).alias("g"), F.col("_root").alias("u"))).otherwise(F.struct(F.lit(False).alias("g"), F.xxhash64("_id").alias("u")))
    units = placed.select("_template", unit.alias("_unit")).distinct().groupBy("_template").agg(F.count(F.lit(1)).alias("_units"))
    often = shared.write(units.filter(F.col("_units") >= min_docs).select("_template"), "units")
    alone = placed.filter("_root is null").select("_row", "_line")
    return alone.unionByName(placed.filter("_root is not null").join(often, "_template", "left_semi").select("_row", "_line"))


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, into: str = "_dropped") -> DataFrame:
    """The documents with their text rid of recurring lines, and the numbers of the dropped lines in `into`."""
    tune(docs.sparkSession)
    shared = Shared(docs.sparkSession, "templates")
    # equal rows of one id are one here; user columns stay out, so no name can clash
    key = F.xxhash64(id_col, text_col)
    bare = docs.select(key.alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    once = bare.filter("_text is not null")
    found, totals = _recurring(once, min_docs, shared)
    found = _judged(shared.write(found.distinct(), "found"), totals, once, min_docs, shared)
    numbers = shared.write(found.groupBy("_row").agg(F.array_sort(F.collect_set("_line")).alias("_numbers")), "numbers")  # at most a text's lines
    for name in ("lines", "docs", "leaves", "open", "some", "distinct", "often", "made", "few", "wanted", "found", "mostly", "texts", "sets", "copies", "placed", "units"):
        shared.drop(name)
    shared.release()
    every = F.struct(*[F.col(c) for c in docs.columns])
    joined = docs.select(every.alias("_doc"), key.alias("_row")).join(numbers.hint("merge"), "_row", "left")
    lines = F.split(F.col(f"_doc.`{text_col}`"), "\n")
    gone = F.coalesce("_numbers", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    # arrays are bound once by a one-element transform
    kept = F.transform(F.array(F.struct(lines.alias("l"), stay.alias("s"))), lambda x: F.array_join(F.transform(x["s"], lambda i: F.get(x["l"], i)), "\n"))[0]
    text = F.when(F.size(gone) > 0, kept).otherwise(F.col(f"_doc.`{text_col}`"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c != into], gone.alias(into))
