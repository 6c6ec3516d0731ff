"""Text search through three-letter grams: rule tables and many patterns at once.

A text that holds a string holds it from some place on. So the first gram of a
string, and then as many letters as the string has, are a join key, and only
texts that hold these letters are looked at. ``label_by_rules`` applies thousands
of regular expressions that way, each by a string that all its matches must hold.
``write_grams`` stores the grams of a catalogue with the letters after them, and
``search_grams`` looks many strings up in it, reading only
the folders of wanted grams. Every candidate is tested exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators.skew import HOT_ROWS, salted_join
from quillgrid.session import materialise

GRAM = 3
# Rules that no string narrows down are tested on every row, so there may be only so many.
MOST_OPEN = 100
FOLDERS = 64
# Letters of a string that texts are looked up by, its first gram included; the rest is tested afterwards.
KEY = 32
# Grams that strings begin with, up to which their table is broadcast.
MOST_GRAMS = 200_000


def grams(text: Column) -> Column:
    """The distinct grams of a text in lower case."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.greatest(F.length(low) - GRAM + 1, F.lit(1)))
    every = F.transform(places, lambda i: F.substr(low, i, F.lit(GRAM)))
    return F.array_distinct(F.filter(every, lambda g: F.length(g) == GRAM))


def required_literal(pattern: str) -> str | None:
    """The longest string of ASCII that every match of a regular expression holds, in lower case; None if none is known.

    Optional parts, alternatives and classes are skipped. A pattern that Python can't read has no known literal.
    """
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    runs, zero_width = [""], {"AT"}

    def walk(items) -> None:
        for kind, value in items:
            name = str(kind)
            if name == "LITERAL" and value < 128:
                runs[-1] += chr(value).lower()
            elif name == "SUBPATTERN":
                walk(value[-1])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                runs.append("")
                walk(value[-1])
                runs.append("")
            elif name not in zero_width:
                runs.append("")

    walk(parsed)
    return max(runs, key=len) or None


def _with_literals(rules: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("pattern")
            found = [None if p is None else required_literal(p) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "literal"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rules.schema)
    return rules.mapInArrow(run, f"{kinds}, literal string")


def _tails(text: Column) -> Column:
    """The distinct starts of all suffixes of a text in lower case, of at most ``KEY`` letters and at least a gram."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.greatest(F.length(low) - GRAM + 1, F.lit(1)))
    every = F.transform(places, lambda i: F.substr(low, i, F.lit(KEY)))
    return F.array_distinct(F.filter(every, lambda t: F.length(t) >= GRAM))


def _gram(text: Column) -> Column:
    return F.substring(text, 1, GRAM)


def _keyed(wanted: DataFrame, column: str) -> DataFrame:
    """``wanted`` with ``key``: the first ``KEY`` letters of a column in lower case; shorter than a gram are left out."""
    return wanted.withColumn("key", F.substring(F.lower(F.col(column)), 1, KEY)).filter(F.length("key") >= GRAM)


def _met(places: DataFrame, keyed: DataFrame, own: str, other: str, hot_rows: int) -> DataFrame:
    """Rows of ``places`` (with ``gram, tail``) and of ``keyed`` (with ``key``) where the tail begins with the key.

    Of a tail only those starts become rows that are as long as some key with its gram.
    """
    sizes = materialise(keyed.select(_gram(F.col("key")).alias("gram"), F.length("key").alias("size")).distinct().groupBy("gram").agg(F.collect_set("size").alias("sizes")))
    # One row per gram, with at most KEY numbers each; beyond that many grams Spark decides.
    few = sizes.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS
    fitting = F.filter("sizes", lambda n: n <= F.length("tail"))
    starts = places.join(F.broadcast(sizes) if few else sizes, "gram").withColumn("size", F.explode(fitting))
    cut = starts.withColumn("key", F.substring(F.col("tail"), F.lit(1), F.col("size"))).drop("gram", "tail", "sizes", "size")
    return salted_join(cut, keyed, ["key"], spread=[F.col(own)], spread_right=[F.col(other)], hot_rows=hot_rows)


def _rule_matches(texts: DataFrame, rules: DataFrame, hot_rows: int) -> DataFrame:
    """``text`` and the columns of ``rules``: texts that hold the first ``KEY`` letters of a rule's literal; some repeat."""
    tails = texts.select("text", F.explode(_tails(F.col("text"))).alias("tail")).withColumn("gram", _gram(F.col("tail")))
    keyed = _keyed(rules.filter(F.col("rule_id").isNotNull()), "literal")
    return _met(tails, keyed, "text", "rule_id", hot_rows).drop("key")


def rule_candidates(texts: DataFrame, rules: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``text, rule_id``: rules with a literal, with the distinct texts that hold the first ``KEY`` letters of it."""
    return _rule_matches(texts, rules, hot_rows).select("text", "rule_id").distinct()


def label_by_rules(df: DataFrame, column: str, rules: DataFrame, default: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``label``: that of the matching rule with the lowest priority number, then id; ``default`` if none matches.

    ``rules`` has ``rule_id, priority, pattern, label``; patterns are Java regular expressions and may match anywhere.
    Rules without a literal of three letters are tested on every row, and at most ``MOST_OPEN`` are accepted. A NULL
    text gets the default, and a rule with a NULL pattern never matches.
    """
    known = materialise(_with_literals(rules.filter(F.col("pattern").isNotNull())))
    open_rules = known.filter(F.coalesce(F.length("literal"), F.lit(0)) < GRAM).limit(MOST_OPEN + 1).collect()
    if len(open_rules) > MOST_OPEN:
        raise ValueError(f"more than {MOST_OPEN} rules hold no string of {GRAM} letters")
    texts = df.select(F.col(column).alias("text")).filter(F.col("text").isNotNull()).distinct()
    met = _rule_matches(texts, known, hot_rows)
    met = met.filter(F.contains(F.lower("text"), F.col("literal")) & F.expr("text rlike pattern"))

    def rank(priority: Column, rule_id: Column, label: Column) -> Column:
        return F.struct(priority.alias("priority"), rule_id.alias("rule_id"), label.alias("label"))

    best = met.groupBy("text").agg(F.min(rank(F.col("priority"), F.col("rule_id"), F.col("label"))).alias("__rule"))
    types = {c: known.schema[c].dataType for c in ("priority", "rule_id", "label")}
    tested = [
        F.when(F.col(column).rlike(r["pattern"]), rank(*[F.lit(r[c]).cast(types[c]) for c in ("priority", "rule_id", "label")]))
        for r in open_rules
    ]
    joined = df.join(best.withColumnRenamed("text", column), column, "left")
    # NULLs lose against any rule.
    found = reduce(F.least, [F.col("__rule"), *tested]) if len(tested) < 2 else F.least(F.col("__rule"), *tested)
    return joined.withColumn("label", F.when(found.isNull(), F.lit(default)).otherwise(found["label"])).select(*df.columns, "label")


def write_grams(catalogue: DataFrame, path: str, id_col: str = "id", text_col: str = "name") -> None:
    """Store for every gram the ids of the rows that hold it, with what follows it, and their number, in folders by a hash of the gram."""
    posted = catalogue.select(F.explode(_tails(F.col(text_col))).alias("tail"), F.col(id_col).alias("id")).withColumn("gram", _gram(F.col("tail")))
    placed = posted.withColumn("folder", F.pmod(F.xxhash64("gram"), F.lit(FOLDERS)).cast("int"))
    # A frequent gram is split over several files, which hold ranges of ids.
    placed.repartition("folder", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("gram", "id").write.partitionBy("folder").parquet(f"{path}/ids")
    stored = catalogue.sparkSession.read.parquet(f"{path}/ids").select("folder", "gram")
    stored.groupBy("folder", "gram").agg(F.count(F.lit(1)).alias("texts")).repartition("folder").write.partitionBy("folder").parquet(f"{path}/counts")


def search_grams(
    spark: SparkSession, path: str, catalogue: DataFrame, patterns: DataFrame, id_col: str = "id", text_col: str = "name", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``pattern_id`` and the columns of ``catalogue``: rows whose text holds a pattern, in any case.

    ``patterns`` has ``pattern_id, pattern``. A pattern with a gram that no text holds is left out; the others are looked
    up by their first gram and what follows it, up to ``KEY`` letters. A pattern shorter than a gram is compared with all rows.
    """
    keyed = materialise(_keyed(patterns.select("pattern_id", "pattern"), "pattern"))
    wanted = materialise(keyed.select("pattern_id", F.explode(grams(F.col("pattern"))).alias("gram")))
    folder = F.pmod(F.xxhash64("gram"), F.lit(FOLDERS)).cast("int")
    folders = [r[0] for r in wanted.select(folder).distinct().collect()]  # at most FOLDERS numbers
    here = F.col("folder").isin(folders) if folders else F.lit(False)
    counts = spark.read.parquet(f"{path}/counts").filter(here).select("gram")
    absent = wanted.join(counts, "gram", "left_anti").select("pattern_id").distinct()
    held = materialise(keyed.join(absent, "pattern_id", "left_anti").select("pattern_id", "key"))
    firsts = [r[0] for r in held.select(F.pmod(F.xxhash64(_gram(F.col("key"))), F.lit(FOLDERS)).cast("int")).distinct().collect()]
    first = F.col("folder").isin(firsts) if firsts else F.lit(False)
    ids = spark.read.parquet(f"{path}/ids").filter(first).select("gram", "tail", "id")
    both = _met(ids, held, "id", "pattern_id", hot_rows).select("pattern_id", "id").distinct()
    rows = catalogue.withColumn("id", F.col(id_col)) if id_col != "id" else catalogue
    exact = both.join(patterns, "pattern_id").join(rows, "id")
    found = exact.filter(F.contains(F.lower(text_col), F.lower("pattern"))).select("pattern_id", *catalogue.columns)
    short = patterns.filter(F.length(F.lower("pattern")) < GRAM)
    few = short.limit(MOST_OPEN + 1).collect()
    if len(few) > MOST_OPEN:
        raise ValueError(f"more than {MOST_OPEN} patterns are shorter than {GRAM} letters")
    for r in few:
        mine = catalogue.filter(F.contains(F.lower(text_col), F.lit(r["pattern"].lower())))
        own = F.lit(r["pattern_id"]).cast(patterns.schema["pattern_id"].dataType).alias("pattern_id")
        found = found.unionByName(mine.select(own, *catalogue.columns))
    return found


def frame_of(spark: SparkSession, rules: Sequence[tuple]) -> DataFrame:
    """A few rules ``(rule_id, priority, pattern, label)`` as a table."""
    return spark.createDataFrame(list(rules), "rule_id bigint, priority bigint, pattern string, label string")
