"""How the vocabularies of sources differ, language by language, in exact integers.

1. Tasks count terms by language and source as they read texts, and hand on one
   row a language and term every some hundred thousand entries, with a list of
   its sources; so a frequent term or source is small before anything is shuffled.
2. (language, term) is hashed to shards. In each DuckDB sums the counts in SQL and
   keeps the terms of enough documents; a shard has whole terms, so that is final.
   What is kept is written as a table in the shared folder.
3. Spark sums sizes of vocabularies and groups, and gives every cell (a term's
   count in a group) its rate p per thousand million, smoothed by one.
4. In shards again, DuckDB makes partial pair sums of the cells that two sources
   share, and the first terms of each group; Spark adds the sums up and ranks.

Few pairs of sources share a term, but the measure also counts terms that one or
both lack. A lacking term has the rate of count 0, the same for all, so these
are summed by how many terms a group has with each rate: no pair of groups is
ever crossed with the vocabulary.

Sources are told apart by a 64-bit hash until their names are put back. Null
texts are empty, null languages and sources the empty string. Repeated rows are
documents of their own; very long texts are read whole. Ties go to the smaller
item by its UTF-8 bytes. An empty table gives no rows, a language with one
source no pairs. Columns of other names are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, cut, shared_path
from .near_duplicates import grouped

LEAST_DOCUMENTS = 3
TERM_RANKS = 200
SCALE = 1_000_000_000
#: Entries that a task counts before it hands them on, and that a shard of cells has about.
ENTRIES_HELD = 400_000
ENTRIES_A_SHARD = 1 << 19
LEAST_SHARDS = 12
#: Shards of each shuffle partition when counts are summed, one after another in memory.
SHARDS_A_PARTITION = 8
#: Rows of a batch handed on.
ROWS_OUT = 16_384

#: Letters and all bytes beyond ASCII stay, capitals in lower case; others part terms.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(TO_TERMS).split()


def by_term(counters: dict[int, tuple[Counter, Counter]]) -> pa.RecordBatch:
    """term, sources, n, docs: a row a term, from counters (occurrences, documents) by source."""
    terms = pa.array([t for counts, _ in counters.values() for t in counts], pa.binary()).dictionary_encode()
    sizes = [len(counts) for counts, _ in counters.values()]
    numbers = lambda k: np.fromiter((x for c in counters.values() for x in c[k].values()), dtype=np.int64, count=sum(sizes))
    place = terms.indices.to_numpy()
    order = np.argsort(place, kind="stable")
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(terms.dictionary)))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (np.repeat(np.array(list(counters), dtype=np.int64), sizes), numbers(0), numbers(1))]
    return pa.RecordBatch.from_arrays([terms.dictionary, *lists], names=["term", "sources", "n", "docs"])


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, term (its bytes), sources, n (occurrences) and docs by source: sums of a part of the rows, several times a term."""

    def run(batches):
        held: dict[str, dict[int, tuple[Counter, Counter]]] = {}
        entries = 0

        def out():
            for lang, counters in held.items():
                made = by_term(counters)
                for at in range(0, made.num_rows, ROWS_OUT):
                    some = made.slice(at, ROWS_OUT)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * some.num_rows, pa.string()), *some.columns], names=["lang", *some.schema.names])
            held.clear()

        for batch in batches:
            for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns)):
                own = Counter(terms_of(raw)) if raw else None
                if not own:
                    continue
                counts, docs = held.setdefault(lang, {}).setdefault(source, (Counter(), Counter()))
                entries -= len(counts)
                counts.update(own)
                docs.update(own.keys())  # in the same order as counts
                entries += len(counts)
                if entries >= ENTRIES_HELD:
                    yield from out()
                    entries = 0
        yield from out()

    lang, source = _group(lang_col, source_col)
    rows = df.select(lang, source, F.col(text_col).cast("binary").alias("raw")).select("lang", F.xxhash64("source").alias("source"), "raw")
    return rows.mapInArrow(run, "lang string, term binary, sources array<long>, n array<long>, docs array<long>")


def _group(lang_col: str, source_col: str):
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]


def in_duckdb(cells: pa.Table, *queries: str) -> list[pa.Table]:
    """Results of SQL over the rows of a shard, the table ``cells``."""
    import duckdb

    with duckdb.connect(config={"threads": 1, "autoinstall_known_extensions": False, "autoload_known_extensions": False}) as con:
        con.register("cells", cells)
        return [con.sql(q).to_arrow_table() for q in queries]


KEPT = """
WITH single AS (SELECT lang, term, unnest(sources) AS source, unnest(n) AS n, unnest(docs) AS docs FROM cells),
summed AS (SELECT lang, term, source, sum(n) AS n, sum(docs) AS docs FROM single GROUP BY ALL)
SELECT lang, term, CAST(sum(n) AS BIGINT) AS lang_n, list(source) AS sources, list(CAST(n AS BIGINT)) AS n FROM summed GROUP BY ALL HAVING sum(docs) >= {least}
"""

#: Of each pair of sources that share a term: what that adds to the sum that has it as a term of only one of them, twice.
PAIRS = """
SELECT a.lang, a.source, b.source AS other, CAST(NULL AS BLOB) AS term,
       CAST(sum((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.p0) * (a.p - b.p0) // b.p0 - (a.p0 - b.p) * (a.p0 - b.p) // b.p + (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0) AS BIGINT) AS value
FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
GROUP BY ALL
"""

FIRST_TERMS = """
SELECT lang, source, CAST(NULL AS BIGINT) AS other, term, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM cells WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {ranks}
"""


def rate(n: str, total: str, terms: str):
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for any long."""
    return F.expr(f"CAST(1 + (CAST({SCALE} AS DECIMAL(38, 0)) * ({n} + 1)) div ({total} + {terms}) AS BIGINT)")


def apart(p: str, q: str):
    """floor((p - q)^2 / q); rates are below 2^30 and a little."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def source_divergence(df: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank. ``pair``: other sources of the language by their distance; ``term``: the terms that mark a source."""
    spark = df.sparkSession
    counted = term_counts(df, text_col, lang_col, source_col).repartition("lang", "term")
    sharded = counted.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(SHARDS_A_PARTITION)).cast("int")).sortWithinPartitions("shard")
    keep = KEPT.format(least=int(least))
    where = shared_path(spark, "divergence")
    sharded.mapInArrow(grouped(["shard"], lambda whole: in_duckdb(whole, keep)[0].to_batches()), "lang string, term binary, lang_n long, sources array<long>, n array<long>").write.parquet(where)
    kept = spark.read.parquet(where)
    each = kept.select("lang", "term", "lang_n", F.inline(F.arrays_zip("sources", "n")).alias("source_id", "count"))

    lang, source = _group(lang_col, source_col)
    occurring = df.select(lang, source).distinct().withColumn("source_id", F.xxhash64("source"))
    sizes = each.groupBy("lang", "source_id").agg(F.sum("count").alias("total"), F.count("*").alias("own"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = occurring.join(sizes, ["lang", "source_id"], "left").join(vocabulary, "lang", "left").fillna(0, ["total", "own", "terms", "lang_total"])
    groups = cut(groups.withColumn("p0", F.when(F.col("terms") > 0, rate("0", "total", "terms"))))  # one row a group
    n_groups, n_cells = groups.agg(F.count("*"), F.coalesce(F.sum("own"), F.lit(0))).first()
    small = lambda g: F.broadcast(g) if n_groups <= BROADCAST_ROWS else g

    rated = each.join(small(groups.select("lang", "source_id", "total", "terms", "lang_total", "p0")), ["lang", "source_id"])
    rated = rated.select("lang", "term", F.col("source_id").alias("source"), rate("count", "total", "terms").alias("p"), rate("lang_n", "lang_total", "terms").alias("q"), "p0")
    shards = max(LEAST_SHARDS, -(-n_cells // ENTRIES_A_SHARD))
    first = FIRST_TERMS.format(ranks=int(ranks))
    cells = rated.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    found = cut(cells.groupBy("shard").applyInArrow(lambda shard: pa.concat_tables(in_duckdb(shard, PAIRS, first)), "lang string, source long, other long, term binary, value long"))
    shared = found.filter("term IS NULL").select("lang", "source", "other", "value")

    # terms of one source alone, by how many it has with each rate: p of the one against p0 of each other, both ways
    spread = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    ours = groups.select("lang", F.col("source_id").alias("source"), "own", "terms", "p0")
    theirs = groups.select("lang", F.col("source_id").alias("other"), F.col("own").alias("other_own"), F.col("p0").alias("q0"))
    against = spread.join(small(theirs), "lang").filter("source <> other")
    forth = against.select("lang", "source", "other", F.expr(f"k * ({apart('p', 'q0')})").alias("value"))
    back = against.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.expr(f"k * ({apart('q0', 'p')})").alias("value"))
    pairs = ours.join(small(theirs), "lang").filter("source <> other")
    neither = pairs.select("lang", "source", "other", F.coalesce(F.expr(f"(terms - own - other_own) * ({apart('p0', 'q0')})"), F.lit(0)).cast("long").alias("value"))
    value = neither.unionByName(forth).unionByName(back).unionByName(shared).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))

    named = lambda rows, column, name: rows.join(small(groups.select("lang", F.col("source_id").alias(column), F.col("source").alias(name))), ["lang", column]).drop(column)
    of_pairs = named(value, "other", "item").withColumn("part", F.lit("pair"))
    of_terms = found.filter("term IS NOT NULL").select("lang", "source", F.col("term").cast("string").alias("item"), "value", F.lit("term").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = of_pairs.unionByName(of_terms).withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= ranks))
    return named(ranked.withColumnRenamed("source", "source_id"), "source_id", "source").select("lang", "source", "part", "item", "value", "rank")
