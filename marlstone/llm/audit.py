"""How filters interact: every order of them, by depth-first survivors that orders share.

The orders of n filters are a trie of n! leaves. A node's survivors depend on
the set of filters passed on the way, not on their order, so the trie folds
into 2^n states. Each state is a persisted DataFrame, made by applying one
filter to its parent's survivors; one aggregation over it counts what every
filter still to come removes there. Parents are given up once their subtree is
done: at most n + 1 states are held at a time. Rows carry the filters'
verdicts, not texts; a lost executor's part of a state is filtered again from
the written verdicts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, staged

#: n! orders are reported; 8 filters have 40,320.
MOST = 8
#: Texts repeated more often than this share of the rows: 1,000 at most, met without a shuffle.
HOT = 1000


def later_copies(docs: DataFrame, id_col: str = "doc_id", key: str = "_key", out: str = "later") -> DataFrame:
    """docs with a boolean: a row of a smaller id has the same key.

    key must be binary or text that stands for the whole text. Rows with a null
    id neither are copies nor make one; rows of one id and one key are no copies
    of each other. Keys held by over one in HOT rows, of which there are no more
    than HOT, are sent to every task; the others meet in a shuffle of those rows
    alone whose key is repeated.
    """
    groups = docs.where(F.col(id_col).isNotNull()).groupBy(key).agg(F.min(id_col).alias("_least"), F.count("*").alias("_n"))
    groups = staged(groups.where("_n > 1"), "repeated-texts")
    many = docs.count() // HOT
    hot = groups.where(F.col("_n") > many).select(F.col(key).alias("_hot"), F.col("_least").alias("_hot_least"))
    cold = groups.where(F.col("_n") <= many).select(key, F.col("_least"))
    met = docs.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    # A row whose key was met needs no second look: a random key of its own keeps it out of any group.
    own = F.when(F.col("_hot").isNull(), F.col(key))
    met = met.withColumn("_own", own).drop(key)
    rest = met.where("_own is not null").join(cold.withColumnRenamed(key, "_own"), "_own", "left")
    done = met.where("_own is null").withColumn("_least", F.col("_hot_least"))
    both = rest.select(*done.columns).unionByName(done)
    later = F.coalesce(F.col(id_col) > F.col("_least"), F.lit(False))
    return both.withColumn(out, later).drop("_hot", "_hot_least", "_own", "_least")


def _states(base: DataFrame, n: int, counts: list[Column], path: str) -> None:
    """Writes, for each state but the last, what each of its filters would remove."""
    seen: set[int] = set()

    def visit(mask: int, survivors: DataFrame) -> None:
        seen.add(mask)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        at = survivors.groupBy("part").agg(*counts)
        at.write.option("compression", "zstd").parquet(f"{path}/mask={mask}")
        for f in range(n):
            child = mask | 1 << f
            if child not in seen and child != (1 << n) - 1:
                visit(child, survivors.where(f"not fail{f}"))
        survivors.unpersist()

    visit(0, base)


def audit(rows: DataFrame, filters: Mapping[str, Column], part: Column, marks: Mapping[str, Column] | None = None) -> DataFrame:
    """part, filter_order, step, filter and counts: one row per part, order of the filters and place in it.

    filters: name (one sign each) and the condition under which a row fails;
    null is no failure. marks: columns of the result that count the rows removed
    at a step for which a condition holds. kept: rows left after the step;
    removed: rows that it removes; redundant: rows that fail its filter but were
    removed before; unique_fails: rows that fail this filter and no other;
    shapley: removed, summed over all orders. A null part is the empty text.
    Every part has all rows, zeros too; an empty table gives an empty result.
    """
    marks, names, n = dict(marks or {}), list(filters), len(filters)
    if not 1 <= n <= MOST or any(len(x) != 1 for x in names):
        raise ValueError(f"1 to {MOST} filters, each with a name of one sign")
    fails = [F.coalesce(c, F.lit(False)).alias(f"fail{i}") for i, c in enumerate(filters.values())]
    held = [F.coalesce(c, F.lit(False)).alias(f"mark{i}") for i, c in enumerate(marks.values())]
    base = staged(rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), *fails, *held), "verdicts")
    path = f"{shared_dir(rows.sparkSession)}/states-{uuid.uuid4().hex}"
    counts = [F.count("*").alias("here")]
    for i in range(n):
        fail = F.col(f"fail{i}")
        counts += [F.count_if(fail).alias(f"fails{i}")]
        counts += [F.count_if(fail & F.col(f"mark{k}")).alias(f"marked{i}_{k}") for k in range(len(marks))]
    _states(base, n, counts, path)
    return _edges(base, path, names, list(marks))


def _edges(base: DataFrame, path: str, names: list[str], marks: list[str]) -> DataFrame:
    spark, n = base.sparkSession, len(names)
    last = (1 << n) - 1
    states = spark.read.option("basePath", path).parquet(*(f"{path}/mask={m}" for m in range(last)))
    counted = [c for i in range(n) for c in (f"fails{i}", *(f"marked{i}_{k}" for k in range(len(marks))))]
    alone = [F.count_if(F.expr(" and ".join(f"{'not ' if j != i else ''}fail{j}" for j in range(n)))).alias(f"alone{i}") for i in range(n)]
    totals = base.groupBy("part").agg(*(F.count_if(F.col(f"fail{i}")).alias(f"total{i}") for i in range(n)), *alone)
    every = totals.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(last - 1))))
    full = every.join(states, ["part", "mask"], "left").na.fill(0, ["here", *counted])
    edge = F.inline(F.array(*(
        F.struct(
            F.lit(i).alias("f"), (F.col("here") - F.col(f"fails{i}")).alias("kept"), F.col(f"fails{i}").alias("removed"),
            (F.col(f"total{i}") - F.col(f"fails{i}")).alias("redundant"), F.col(f"alone{i}").alias("unique_fails"),
            *(F.col(f"marked{i}_{k}").alias(m) for k, m in enumerate(marks)),
        ) for i in range(n)
    )))
    fields = ["f", "kept", "removed", "redundant", "unique_fails", *marks]
    edges = full.select("part", "mask", edge).toDF("part", "mask", *fields).where(F.expr("(mask & shiftleft(1, f)) = 0"))
    passed = F.bit_count(F.col("mask"))
    ways = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), passed + 1)
    shapley = edges.groupBy("part", "f").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    orders = [
        ("".join(names[i] for i in order), step + 1, sum(1 << i for i in order[:step]), order[step])
        for order in permutations(range(n)) for step in range(n)
    ]
    trie = spark.createDataFrame(orders, "filter_order string, step int, mask int, f int")
    trie = trie.withColumn("filter", F.element_at(F.array(*map(F.lit, names)), F.col("f") + 1))
    found = edges.join(shapley, ["part", "f"]).join(F.broadcast(trie), ["mask", "f"])
    return found.select("part", "filter_order", "step", "filter", *fields[1:], "shapley")


def text_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, A to E, good, toxic): one row per row of docs, texts left behind.

    A: under 100 words; B: fewer than 80 in 100 words are distinct; C: over 10
    in 100 signs are A-Z; D: one of #$%&*| is in the text; E: a smaller id has
    the very same text (told by SHA-256). Null texts are empty and fail A alone,
    or E too. labels (doc_id, quality, toxic): several rows of an id count if
    one does; ids without labels are neither good nor toxic.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("_id"), F.col(part_col).alias("part"), text.alias("_text"))
    words = words.withColumn("_words", F.array_remove(F.split("_text", r"[ \t-\r]+"), ""))
    n, upper = F.size("_words"), F.length(F.regexp_replace("_text", "[^A-Z]+", ""))
    rows = words.select(
        "_id", "part", F.unhex(F.sha2("_text", 256)).alias("_key"), (n < 100).alias("A"),
        (100 * F.size(F.array_distinct("_words")) < 80 * n).alias("B"), (100 * upper > 10 * F.length("_text")).alias("C"),
        F.col("_text").rlike(r"[#$%&*|]").alias("D"),
    )
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_labelled"))
    told = told.agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    flagged = later_copies(staged(rows, "text-rules"), "_id", "_key", "E")
    return flagged.join(told, F.col("_id") == F.col("_labelled"), "left").select("part", *"ABCDE", "good", "toxic")


def oracle() -> str:
    """DuckDB SQL for the five filters over documents and labels, all orders."""
    letters = "ABCDE"
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(letters))
    bit = "(1 << (ascii({0}) - 65))"
    own, before = bit.format("substr(filter_order, step, 1)"), " + ".join(
        f"CASE WHEN step > {k} THEN {bit.format(f'substr(filter_order, {k}, 1)')} ELSE 0 END" for k in range(1, 5)
    )
    return f"""
    WITH texts AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    least AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
    told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    flags AS (
      SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS fails,
        coalesce(good, false) AS good, coalesce(toxic, false) AS bad
      FROM texts JOIN least USING (t) LEFT JOIN told USING (doc_id)
    ),
    classes AS (SELECT part, fails, good, bad, count(*) AS n FROM flags GROUP BY ALL),
    steps AS (
      SELECT filter_order, step, {own} AS own, {before} AS before
      FROM (VALUES {orders}) AS o(filter_order), (SELECT unnest(range(1, 6)) AS step)
    ),
    found AS (
      SELECT part, filter_order, step::INT AS step, substr(filter_order, step, 1) AS filter,
        sum(CASE WHEN fails & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN fails & own > 0 AND fails & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN fails & own > 0 AND fails & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN good AND fails & own > 0 AND fails & before = 0 THEN n ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN bad AND fails & own > 0 AND fails & before = 0 THEN n ELSE 0 END)::BIGINT AS toxic_lost
      FROM classes, steps GROUP BY ALL
    )
    SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM found
    """
