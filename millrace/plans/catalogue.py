"""The registered queries and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prf import client_seed, sql_hex, sql_mod, sql_unit
from ..functions.records import json_problem, json_valid
from ..operators import analyze, frames, records, shuffle, verify
from ..operators.shared import cut, shared_path
from ..sources import seekable, units
from ..sources.jsonl import read_records, to_json_record, write_records
from ..sources.shards import read_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SEED = 7
CAP = 4096
WORLD = 4
FRAME = 16 << 10
BUFFER, RESERVOIR = 100, 50
MIN_BITS, MAX_BITS = 4.0, 4.6


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return records.record_view(table(spark, sf_dir, "documents"), "doc_id", "text", *keep)


def positioned(df: DataFrame, *order: str) -> DataFrame:
    return records.with_position(df, *(order or ("id",)))


DOC = "doc AS (SELECT doc_id AS id, coalesce(text, '') AS record, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS nbytes, source, lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)"
EVENT = "ev AS (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)"


def stats_sql(out: str, skipped: str, passed: str) -> str:
    return f"""WITH {DOC} SELECT count(*) AS records_in, CAST(sum(CASE WHEN {out} THEN 1 ELSE 0 END) AS BIGINT) AS records_out,
CAST(sum(nbytes) AS BIGINT) AS bytes_in, CAST(sum(CASE WHEN {out} THEN nbytes ELSE 0 END) AS BIGINT) AS bytes_out,
CAST(sum(CASE WHEN {skipped} THEN 1 ELSE 0 END) AS BIGINT) AS oversized_skipped, CAST(sum(CASE WHEN {passed} THEN 1 ELSE 0 END) AS BIGINT) AS oversized_passthrough FROM doc"""


@query(stats_sql("nbytes <= 16777216", "nbytes > 16777216", "false"))
def passthrough_stats(spark, sf_dir):
    return records.run_stats(documents(spark, sf_dir), records.DEFAULT_MAX_LINE)


@query(stats_sql(f"nbytes <= {CAP}", f"nbytes > {CAP}", "false"))
def oversize_skip(spark, sf_dir):
    return records.run_stats(documents(spark, sf_dir), CAP, "skip")


@query(stats_sql("true", "false", f"nbytes > {CAP}"))
def oversize_passthrough(spark, sf_dir):
    return records.run_stats(documents(spark, sf_dir), CAP, "passthrough")


@query(f"WITH {DOC} SELECT id, pos AS out_pos FROM doc")
def passthrough(spark, sf_dir):
    return positioned(documents(spark, sf_dir)).select("id", F.col("pos").alias("out_pos"))


@query(f"WITH {DOC} SELECT id, nbytes FROM doc WHERE nbytes <= {CAP}")
def policy_skip_rows(spark, sf_dir):
    return records.limit_length(documents(spark, sf_dir), CAP).select("id", "nbytes")


@query(f"WITH {DOC} SELECT id, pos FROM doc WHERE pos % {WORLD} = 1")
def rank_partition_rows(spark, sf_dir):
    return records.of_rank(positioned(documents(spark, sf_dir)), 1, WORLD).select("id", "pos")


@query(f"WITH {EVENT} SELECT id, pos FROM ev WHERE pos < 100")
def sample_head(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return records.head(positioned(events), 100).select("id", "pos")


@query(f"WITH {DOC} SELECT id FROM doc WHERE {sql_unit(SEED, 'bern', 0, 'id')} < 0.3")
def bernoulli_sample(spark, sf_dir):
    return records.bernoulli(documents(spark, sf_dir), 0.3, SEED).select("id")


@query(f"SELECT o_orderkey AS id FROM orders WHERE {sql_unit(SEED, 'bern', 0, 'o_orderkey')} < 0.05")
def bernoulli_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return records.bernoulli(orders, 0.05, SEED).select("id")


BYTES = f"""{DOC},
one AS (SELECT id, hex(encode(record || chr(10))) AS h, nbytes FROM doc),
byte AS (SELECT id, nbytes, substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS b, count(*) AS n FROM one, range(0, nbytes) AS r(i) GROUP BY ALL),
ent AS (SELECT id, -sum((n / CAST(nbytes AS DOUBLE)) * ln(n / CAST(nbytes AS DOUBLE))) AS entropy FROM byte GROUP BY id)"""
LOW, HIGH = MIN_BITS * records.LN2, MAX_BITS * records.LN2


@query(f"WITH {BYTES} SELECT id, round(entropy, 6) AS entropy FROM ent")
def record_entropy(spark, sf_dir):
    return records.entropy_gate(documents(spark, sf_dir)).select("id", F.round("entropy", 6).alias("entropy"))


@query(f"WITH {BYTES} SELECT id FROM ent WHERE entropy >= {LOW} AND entropy <= {HIGH}")
def entropy_gate(spark, sf_dir):
    return records.entropy_gate(documents(spark, sf_dir), MIN_BITS, MAX_BITS).select("id")


@query(f"""WITH {BYTES} SELECT CAST(sum(CASE WHEN entropy >= {LOW} AND entropy <= {HIGH} THEN 1 ELSE 0 END) AS BIGINT) AS kept,
CAST(sum(CASE WHEN entropy < {LOW} THEN 1 ELSE 0 END) AS BIGINT) AS dropped_low, CAST(sum(CASE WHEN entropy > {HIGH} THEN 1 ELSE 0 END) AS BIGINT) AS dropped_high FROM ent""")
def entropy_gate_counts(spark, sf_dir):
    return records.gate_counts(documents(spark, sf_dir), MIN_BITS, MAX_BITS)


@query(f"WITH {BYTES} SELECT id, pos FROM ent JOIN doc USING (id) WHERE {sql_unit(SEED, 'bern', 0, 'id')} < 0.5 AND entropy >= {LOW} AND entropy <= {HIGH} ORDER BY pos LIMIT 50")
def sampling_pipeline(spark, sf_dir):
    df = positioned(documents(spark, sf_dir))
    return records.sampling_pipeline(df, 0.5, SEED, MIN_BITS, MAX_BITS, 50).select("id", "pos")


PERM = f"{DOC}, perm AS (SELECT id, row_number() OVER (ORDER BY {sql_hex(SEED, 'perm', 0, 'id')}, id) - 1 AS out_pos FROM doc)"


@query(f"WITH {PERM} SELECT * FROM perm")
def index_perm(spark, sf_dir):
    return shuffle.index_perm(documents(spark, sf_dir), SEED).select("id", "out_pos")


@query(f"SELECT o_orderkey AS id, row_number() OVER (ORDER BY {sql_hex(SEED, 'perm', 0, 'o_orderkey')}, o_orderkey) - 1 AS out_pos FROM orders")
def index_perm_orders(spark, sf_dir):
    return shuffle.index_perm(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), SEED).select("id", "out_pos")


@query(f"WITH {DOC} SELECT CAST(epoch AS INTEGER) AS epoch, id, row_number() OVER (PARTITION BY epoch ORDER BY {sql_hex(SEED, 'perm', 'epoch', 'id')}, id) - 1 AS out_pos FROM doc, range(0, 3) AS e(epoch)")
def index_perm_epochs(spark, sf_dir):
    return shuffle.index_perm_epochs(documents(spark, sf_dir), 3, SEED).select("epoch", "id", "out_pos")


@query(f"WITH {PERM} SELECT * FROM perm WHERE out_pos % {WORLD} = 2")
def index_perm_rank(spark, sf_dir):
    return records.of_rank(shuffle.index_perm(documents(spark, sf_dir), SEED), 2, WORLD, "out_pos").select("id", "out_pos")


@query(f"WITH {PERM} SELECT * FROM perm WHERE out_pos < 64")
def index_perm_sample(spark, sf_dir):
    return shuffle.sample(documents(spark, sf_dir), 64, SEED).select("id", "out_pos")


@query(f"WITH {PERM} SELECT * FROM perm WHERE out_pos >= 500")
def index_perm_resume(spark, sf_dir):
    return shuffle.resume(shuffle.index_perm(documents(spark, sf_dir), SEED), 500).select("id", "out_pos")


CLIENTS = ("one", "two", "three")


@query(" UNION ALL ".join(f"SELECT '{c}' AS client, doc_id AS id, row_number() OVER (ORDER BY {sql_hex(client_seed(SEED, c), 'perm', 0, 'doc_id')}, doc_id) - 1 AS out_pos FROM documents" for c in CLIENTS))
def client_permutations(spark, sf_dir):
    """The permutation of each of several clients under one seed of the server."""
    docs = documents(spark, sf_dir).select("id")
    out = None
    for c in CLIENTS:
        one = shuffle.index_perm(docs, client_seed(SEED, c)).select(F.lit(c).alias("client"), "id", "out_pos")
        out = one if out is None else out.unionByName(one)
    return out


def frames_sql(order: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Frames of a table's records taken in an order, as rows of framed."""
    return f"""doc AS (SELECT {key} AS id, coalesce({text}, '') AS record, CAST(strlen(coalesce({text}, '')) + 1 AS BIGINT) AS nbytes, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM {table}),
run AS (SELECT *, CAST(sum(nbytes) OVER (ORDER BY pos) AS BIGINT) AS cum FROM doc),
nxt AS (SELECT a.pos, (SELECT min(b.pos) + 1 FROM run b WHERE b.cum >= a.cum - a.nbytes + {FRAME}) AS nxt FROM run a),
st AS (SELECT CAST(0 AS BIGINT) AS frame_id, CAST(0 AS BIGINT) AS pos UNION ALL
       SELECT frame_id + 1, nxt FROM st JOIN nxt USING (pos) WHERE nxt IS NOT NULL AND nxt < (SELECT count(*) FROM {table})),
framed AS (SELECT run.*, CAST(st.frame_id AS INTEGER) AS frame_id FROM run ASOF JOIN st ON run.pos >= st.pos)"""


def framed(spark, sf_dir, *order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, pos, nbytes, frame_id and ``keep`` of documents."""
    df = positioned(documents(spark, sf_dir, "lang").select(*{"id": 0, "nbytes": 0} | dict.fromkeys((*order, *keep))), *order)
    return frames.assign_frames(df, FRAME, in_order=True)


@query(f"WITH RECURSIVE {frames_sql('doc_id')} SELECT id, pos, frame_id FROM framed")
def frames_greedy(spark, sf_dir):
    return framed(spark, sf_dir).select("id", "pos", "frame_id")


@query(f"""WITH RECURSIVE {frames_sql('doc_id')}, f AS (SELECT frame_id, count(*) AS records, CAST(sum(nbytes) AS BIGINT) AS bytes FROM framed GROUP BY 1)
SELECT count(*) AS frames, CAST(sum(records) AS BIGINT) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, min(bytes) AS min_frame, max(bytes) AS max_frame,
list_sort(list(bytes))[count(*) // 2 + 1] AS median_frame FROM f""")
def frame_info(spark, sf_dir):
    return frames.frame_info(framed(spark, sf_dir))


@query(f"""WITH RECURSIVE {frames_sql('doc_id')}, f AS (SELECT frame_id, count(*) AS records, CAST(sum(nbytes) AS BIGINT) AS bytes FROM framed GROUP BY 1)
SELECT frame_id, records, bytes, CAST(sum(bytes) OVER (ORDER BY frame_id) - bytes AS BIGINT) AS start FROM f""")
def frame_table(spark, sf_dir):
    return frames.frame_table(framed(spark, sf_dir))


@query(f"WITH RECURSIVE {frames_sql('doc_id')} SELECT id, pos AS idx, frame_id, CAST(sum(nbytes) OVER (PARTITION BY frame_id ORDER BY pos) - nbytes AS BIGINT) AS offset_in_frame, nbytes AS length FROM framed")
def record_index(spark, sf_dir):
    return frames.record_index(framed(spark, sf_dir))


@query(f"WITH {DOC} SELECT id, pos AS idx, CAST(sum(nbytes) OVER (ORDER BY pos) - nbytes AS BIGINT) AS start, CAST(sum(nbytes) OVER (ORDER BY pos) AS BIGINT) AS \"end\" FROM doc")
def byte_offsets(spark, sf_dir):
    return frames.byte_offsets(positioned(documents(spark, sf_dir)))


CHUNKS = f"""{frames_sql('doc_id')},
ids AS (SELECT DISTINCT frame_id FROM framed),
fp AS (SELECT frame_id, row_number() OVER (ORDER BY {sql_hex(SEED, 'perm', 0, 'frame_id')}, frame_id) - 1 AS frame_pos FROM ids),
rp AS (SELECT id, framed.frame_id, frame_pos, row_number() OVER (PARTITION BY framed.frame_id ORDER BY {sql_hex(SEED, 'frame', 0, 'framed.frame_id', 'id')}, id) - 1 AS rec_pos FROM framed JOIN fp USING (frame_id))"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT *, row_number() OVER (ORDER BY frame_pos, rec_pos) - 1 AS out_pos FROM rp")
def chunk_shuffled(spark, sf_dir):
    return shuffle.chunk_shuffled(framed(spark, sf_dir), SEED).select("id", "frame_id", "frame_pos", "rec_pos", "out_pos")


@query(f"WITH RECURSIVE {CHUNKS} SELECT *, row_number() OVER (ORDER BY frame_pos, rec_pos) - 1 AS out_pos FROM rp WHERE frame_pos % {WORLD} = 3")
def chunk_shuffled_rank(spark, sf_dir):
    return shuffle.chunk_shuffled(framed(spark, sf_dir), SEED, rank=3, world=WORLD).select("id", "frame_id", "frame_pos", "rec_pos", "out_pos")


@query(f"WITH RECURSIVE {CHUNKS} SELECT id, frame_pos // 8 AS turn, rec_pos, frame_pos FROM rp")
def chunk_round_robin(spark, sf_dir):
    return shuffle.chunk_round_robin(framed(spark, sf_dir), SEED, active=8).select("id", "turn", "rec_pos", "frame_pos")


@query(f"""WITH RECURSIVE {CHUNKS}, sized AS (SELECT *, count(*) OVER (PARTITION BY frame_id) AS n FROM rp),
timed AS (SELECT *, (CAST(rec_pos AS DOUBLE) + {sql_unit(SEED, 'stride', 0, 'frame_id', 'id')}) / n AS share FROM sized),
clock AS (SELECT *, CASE WHEN frame_pos < 8 THEN share * (frame_pos + 1) / 8 ELSE CAST(frame_pos - 7 AS DOUBLE) / 8 + share END AS time FROM timed)
SELECT id, frame_pos, rec_pos, row_number() OVER (ORDER BY time, frame_pos, rec_pos) - 1 AS out_pos FROM clock""")
def interleaved_frames(spark, sf_dir):
    """Eight frames at a time, mixed; the next one takes the place of one that ends."""
    return shuffle.interleaved(framed(spark, sf_dir), 8, SEED).select("id", "frame_pos", "rec_pos", "out_pos")


def buffer_sql(source: str, group: str | None) -> str:
    part = f"PARTITION BY {group}" if group else ""
    ids = [*([group] if group else []), "pos"]
    cols = f"{group}, " if group else ""
    return f"""s AS (SELECT *, CASE WHEN pos < {BUFFER} THEN pos ELSE {sql_mod(SEED, 'buf', 0, BUFFER, *ids)} END AS slot, count(*) OVER ({part}) AS n FROM {source}),
l AS (SELECT *, lead(pos) OVER (PARTITION BY {cols}slot ORDER BY pos) AS nxt FROM s)
SELECT {cols}id, nxt - {BUFFER} AS out_pos FROM l WHERE nxt IS NOT NULL UNION ALL
SELECT {cols}id, n - count(*) OVER ({part}) + row_number() OVER ({part} ORDER BY {sql_hex(SEED, 'drain', 0, *ids)}, pos) - 1 AS out_pos FROM l WHERE nxt IS NULL"""


@query(f"WITH {EVENT}, {buffer_sql('ev', None)}")
def buffer_shuffle(spark, sf_dir):
    events = positioned(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")))
    return shuffle.buffer_shuffle(events, BUFFER, SEED).select("id", "out_pos")


def epochs_of_events(spark, sf_dir) -> DataFrame:
    return shuffle.with_epochs(positioned(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))), 2)


EVENT_EPOCHS = f"{EVENT}, ee AS (SELECT CAST(epoch AS INTEGER) AS epoch, ev.* FROM ev, range(0, 2) AS e(epoch))"


@query(f"WITH {EVENT_EPOCHS}, {buffer_sql('ee', 'epoch')}")
def buffer_epochs(spark, sf_dir):
    return shuffle.buffer_shuffle(epochs_of_events(spark, sf_dir), BUFFER, SEED, group="epoch").select("epoch", "id", "out_pos")


@query("SELECT CAST(epoch AS INTEGER) AS epoch, count(*) AS records FROM events, range(0, 2) AS e(epoch) GROUP BY 1")
def epoch_counts(spark, sf_dir):
    return shuffle.epoch_counts(shuffle.buffer_shuffle(epochs_of_events(spark, sf_dir), BUFFER, SEED, group="epoch"))


BY_LANG = "bl AS (SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents)"


def by_language(spark, sf_dir) -> DataFrame:
    """Documents as one input per language, with positions in each."""
    df = positioned(documents(spark, sf_dir, "lang").select("id", "lang"), "lang", "id")
    first = df.groupBy("lang").agg(F.min("pos").alias("first"))
    return df.join(first, "lang").withColumn("pos", F.col("pos") - F.col("first")).drop("first")


@query(f"WITH {BY_LANG}, {buffer_sql('bl', 'lang')}")
def buffer_multi_input(spark, sf_dir):
    return shuffle.buffer_shuffle(by_language(spark, sf_dir), BUFFER, SEED, group="lang").select("lang", "id", "out_pos")


def reservoir_sql(source: str, group: str | None) -> str:
    part = f"PARTITION BY {group}" if group else ""
    ids = [*([group] if group else []), "pos"]
    cols = f"{group}, " if group else ""
    return f"""s AS (SELECT *, CASE WHEN pos < {RESERVOIR} THEN pos ELSE {sql_mod(SEED, 'res', 0, 'pos + 1', *ids)} END AS slot FROM {source}),
k AS (SELECT {cols}slot, max(pos) AS pos, max_by(id, pos) AS id FROM s WHERE slot < {RESERVOIR} GROUP BY {cols}slot)
SELECT {cols}id, row_number() OVER ({part} ORDER BY {sql_hex(SEED, 'resorder', 0, *ids)}, pos) - 1 AS out_pos FROM k"""


@query(f"WITH {DOC}, {reservoir_sql('doc', None)}")
def reservoir_sample(spark, sf_dir):
    return shuffle.reservoir(positioned(documents(spark, sf_dir).select("id")), RESERVOIR, SEED).select("id", "out_pos")


@query(f"WITH {DOC}, mine AS (SELECT id, row_number() OVER (ORDER BY pos) - 1 AS pos FROM doc WHERE pos % {WORLD} = 1), {reservoir_sql('mine', None)}")
def reservoir_rank(spark, sf_dir):
    mine = records.of_rank(positioned(documents(spark, sf_dir).select("id")), 1, WORLD)
    mine = mine.withColumn("pos", F.floor(F.col("pos") / WORLD).cast("long"))  # places among the rank's own rows
    return shuffle.reservoir(mine, RESERVOIR, SEED).select("id", "out_pos")


@query(f"WITH {BY_LANG}, {reservoir_sql('bl', 'lang')}")
def reservoir_multi_input(spark, sf_dir):
    return shuffle.reservoir(by_language(spark, sf_dir), RESERVOIR, SEED, group="lang").select("lang", "id", "out_pos")


@query(f"WITH {EVENT_EPOCHS}, {reservoir_sql('ee', 'epoch')}")
def reservoir_epochs(spark, sf_dir):
    return shuffle.reservoir(epochs_of_events(spark, sf_dir), RESERVOIR, SEED, group="epoch").select("epoch", "id", "out_pos")


HISTOGRAM = f"""{frames_sql('lang, doc_id')},
hx AS (SELECT frame_id, hex(encode(record || chr(10))) AS h, nbytes FROM framed),
hist AS (SELECT frame_id, CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS byte, count(*) AS n FROM hx, range(0, nbytes) AS r(i) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {HISTOGRAM} SELECT frame_id, byte, n FROM hist")
def analyze_histogram(spark, sf_dir):
    return analyze.byte_histogram(framed(spark, sf_dir, "lang", "id", keep=("record",)))


DIVERGENCE = f"""{HISTOGRAM},
q AS (SELECT byte, sum(n) / (SELECT CAST(sum(n) AS DOUBLE) FROM hist) AS q FROM hist GROUP BY byte),
grid AS (SELECT frame_id, q.byte, q, coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY frame_id) AS DOUBLE) AS p
         FROM (SELECT DISTINCT frame_id FROM hist) CROSS JOIN q LEFT JOIN hist USING (frame_id, byte)),
d AS (SELECT frame_id, sum(CASE WHEN p > 0 THEN p * ln(p / q) ELSE 0 END) AS kl,
      0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(q * ln(q / ((p + q) / 2))) AS js,
      -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS entropy FROM grid GROUP BY frame_id)"""


@query(f"WITH RECURSIVE {DIVERGENCE} SELECT frame_id, round(kl, 6) AS kl, round(js, 6) AS js, round(entropy, 6) AS entropy FROM d")
def analyze_divergence(spark, sf_dir):
    out = analyze.divergence(analyze.byte_histogram(framed(spark, sf_dir, "lang", "id", keep=("record",))))
    return out.select("frame_id", *(F.round(c, 6).alias(c) for c in ("kl", "js", "entropy")))


def _label(x: str, t: float) -> str:
    return f"CASE WHEN {x} < 0.5 * {t} THEN 'uniform' WHEN {x} < {t} THEN 'mild drift' ELSE 'SKEWED' END"


@query(f"""WITH RECURSIVE {frames_sql('lang, doc_id').replace('framed AS', 'all_frames AS')},
pick AS (SELECT frame_id FROM (SELECT DISTINCT frame_id FROM all_frames) ORDER BY {sql_hex(0, 'analyze', 0, 'frame_id')}, frame_id LIMIT 32),
framed AS (SELECT * FROM all_frames WHERE frame_id IN (SELECT frame_id FROM pick)),
{DIVERGENCE.split('FROM run ASOF JOIN st ON run.pos >= st.pos),')[1]},
v AS (SELECT count(*) AS frames, max(kl) AS kl_max, avg(kl) AS kl_mean, max(js) AS js_max, avg(js) AS js_mean, avg(entropy) AS entropy_mean FROM d),
c AS (SELECT stddev_pop(m) / avg(m) AS length_cv FROM (SELECT avg(nbytes) AS m FROM framed GROUP BY frame_id))
SELECT frames, round(kl_max, 6) AS kl_max, round(kl_mean, 6) AS kl_mean, round(js_max, 6) AS js_max, round(js_mean, 6) AS js_mean, round(entropy_mean, 6) AS entropy_mean,
round(length_cv, 6) AS length_cv, {_label('kl_max', 0.1)} AS kl_label, {_label('js_max', 0.1)} AS js_label, {_label('length_cv', 0.5)} AS cv_label,
CASE WHEN kl_max > 0.1 OR js_max > 0.1 OR length_cv > 0.5 THEN 'UNSAFE' ELSE 'SAFE' END AS verdict FROM v, c""")
def analyze_verdict(spark, sf_dir):
    out = analyze.report(framed(spark, sf_dir, "lang", "id"), records=documents(spark, sf_dir))
    return out.select("frames", *(F.round(c, 6).alias(c) for c in ("kl_max", "kl_mean", "js_max", "js_mean", "entropy_mean", "length_cv")), "kl_label", "js_label", "cv_label", "verdict")


@query(f"""WITH RECURSIVE {frames_sql('lang, doc_id').replace('framed AS', 'all_frames AS')},
pick AS (SELECT frame_id FROM (SELECT DISTINCT frame_id FROM all_frames) ORDER BY {sql_hex(0, 'analyze', 0, 'frame_id')}, frame_id LIMIT 32),
framed AS (SELECT * FROM all_frames WHERE frame_id IN (SELECT frame_id FROM pick)),
q AS (SELECT quantile_cont(nbytes, [0.1, 0.5, 0.9]) AS q FROM framed),
len AS (SELECT frame_id, list_max(list_transform(list_zip(p, q), lambda x: abs(x[1] / x[2] - 1))) AS d FROM (SELECT frame_id, quantile_cont(nbytes, [0.1, 0.5, 0.9]) AS p FROM framed GROUP BY frame_id), q),
word AS (SELECT frame_id, regexp_extract(record, '^[\\t\\n\\x0B\\f\\r ]*([^\\t\\n\\x0B\\f\\r ]+)', 1) AS w, count(*) AS n FROM framed GROUP BY ALL),
kl AS (SELECT frame_id, sum(p * ln(p / q)) AS kl FROM (SELECT frame_id, n / CAST(sum(n) OVER (PARTITION BY frame_id) AS DOUBLE) AS p, sum(n) OVER (PARTITION BY w) / CAST(sum(n) OVER () AS DOUBLE) AS q FROM word) GROUP BY frame_id)
SELECT round(max(d), 6) AS length_drift_max, round(avg(d), 6) AS length_drift_mean, round(max(kl), 6) AS prefix_kl_max, round(avg(kl), 6) AS prefix_kl_mean FROM len JOIN kl USING (frame_id)""")
def analyze_drift(spark, sf_dir):
    """Lengths and first words of frames against those of all, exactly."""
    out = analyze.drift(framed(spark, sf_dir, "lang", "id"), records=documents(spark, sf_dir), accuracy=None)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def broken_events(spark, sf_dir) -> DataFrame:
    """Event properties, two in ten of them damaged."""
    i = F.col("event_id") % 10
    text = F.when(i == 3, F.concat("props", F.lit(" x"))).when(i == 7, F.expr("substr(props, 2)")).otherwise(F.col("props"))
    return records.record_view(table(spark, sf_dir, "events"), "event_id", text)


BROKEN_SQL = "bad AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 3 THEN props || ' x' WHEN event_id % 10 = 7 THEN substr(props, 2) ELSE props END AS record FROM events)"


@query(f"WITH {BROKEN_SQL} SELECT id FROM bad WHERE NOT json_valid(record)")
def verify_json(spark, sf_dir):
    return broken_events(spark, sf_dir).filter(~json_valid("record")).select("id")


@query(f"""WITH {BROKEN_SQL} SELECT count(*) AS records, CAST(sum(strlen(record) + 1) AS BIGINT) AS bytes, CAST(sum(CASE WHEN strlen(record) + 1 > 64 THEN 1 ELSE 0 END) AS BIGINT) AS oversized,
CAST(sum(CASE WHEN json_valid(record) THEN 0 ELSE 1 END) AS BIGINT) AS invalid_json, false AS ok FROM bad""")
def verify_report(spark, sf_dir):
    return verify.verify(broken_events(spark, sf_dir), 64)


@query(f"WITH {BROKEN_SQL}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, record FROM bad) SELECT id, pos FROM p WHERE NOT json_valid(record) ORDER BY pos LIMIT 8")
def verify_first_problems(spark, sf_dir):
    return verify.problems(positioned(broken_events(spark, sf_dir))).select("id", "pos")


CUT_BY_ID = "CASE WHEN event_id % 10 = 3 THEN props || ' x' WHEN event_id % 10 = 7 THEN substr(props, 2) WHEN event_id % 10 = 1 THEN substr(props, 1, length(props) - 1) ELSE props END"


@query(f"""WITH bad AS (SELECT event_id AS id, {CUT_BY_ID} AS record, props FROM events WHERE event_id % 10 IN (1, 3, 7))
SELECT id, CASE WHEN id % 10 = 1 THEN 'unexpected_eof' ELSE 'trailing' END AS kind,
CAST(CASE WHEN id % 10 = 1 THEN strlen(record) WHEN id % 10 = 3 THEN strlen(props) + 1 ELSE strlen(regexp_extract(record, '^"[^"]*" *')) END AS BIGINT) AS at FROM bad""")
def json_problem_kinds(spark, sf_dir):
    """What is wrong with damaged properties, and at which byte."""
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(CUT_BY_ID).alias("record"))
    return df.withColumn("p", json_problem("record")).filter("p.kind IS NOT NULL").select("id", "p.kind", "p.at")


@query("SELECT mode, count(*) AS n_rows, count(*) AS covered, CAST(0 AS BIGINT) AS overlap, CAST(0 AS BIGINT) AS \"foreign\" FROM documents, (VALUES ('chunk-shuffled'), ('index-perm'), ('none')) AS m(mode) GROUP BY mode")
def rank_modes_cover(spark, sf_dir):
    """What the ranks of each mode get, against the documents."""
    docs = cut(framed(spark, sf_dir).select("id", "pos", "frame_id"))
    modes = {
        "none": lambda r: records.of_rank(docs, r, WORLD),
        "index-perm": lambda r: records.of_rank(shuffle.index_perm(docs, SEED), r, WORLD, "out_pos"),
        "chunk-shuffled": lambda r: shuffle.chunk_shuffled(docs, SEED, rank=r, world=WORLD),
    }
    found = [verify.ranks_cover(docs, [mode(r) for r in range(WORLD)]).withColumn("mode", F.lit(name)) for name, mode in modes.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"SELECT count(*) AS n_rows, count(*) AS covered, CAST(0 AS BIGINT) AS overlap FROM documents")
def rank_cover_check(spark, sf_dir):
    return verify.rank_cover(positioned(documents(spark, sf_dir).select("id")), WORLD)


@query("""SELECT n_nationkey AS id, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS record FROM nation""")
def to_jsonl_row(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.col("n_nationkey").alias("id"), to_json_record(nation).alias("record"))


@query("""SELECT CAST(0 AS INTEGER) AS file_id, CAST(r_regionkey AS BIGINT) AS id, CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS pos FROM region UNION ALL
SELECT 1, n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 + (SELECT count(*) FROM region) FROM nation""")
def multi_input_concat(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return positioned(records.concat(region, nation), "file_id", "id").select("file_id", "id", "pos")


@query(f"""SELECT 'customer' AS input, c_custkey AS id FROM customer WHERE {sql_unit(SEED, 'mix:customer', 0, 'c_custkey')} < 0.2 UNION ALL
SELECT 'part', p_partkey FROM part WHERE {sql_unit(SEED, 'mix:part', 0, 'p_partkey')} < 0.5""")
def weighted_mix(spark, sf_dir):
    frames_of = {"customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "part": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))}
    return records.weighted_mix(frames_of, {"customer": 0.2, "part": 0.5}, SEED).select("input", "id")


def event_records(spark, sf_dir) -> DataFrame:
    """Properties of events, one line each, in frames."""
    return frames.assign_frames(positioned(records.record_view(table(spark, sf_dir, "events"), "event_id", "props")), FRAME, in_order=True)


def written_events(spark, sf_dir) -> str:
    out = shared_path(spark, "seekable")
    seekable.write_seekable(event_records(spark, sf_dir), out)
    return out


EVENT_FRAMES = frames_sql("event_id", "events", "event_id", "props")


@query(f"WITH RECURSIVE {EVENT_FRAMES} SELECT md5(record) AS record_md5, CAST(sum(nbytes) OVER (PARTITION BY frame_id ORDER BY pos) - nbytes AS BIGINT) AS offset_in_frame, count(*) OVER (PARTITION BY frame_id) AS records FROM framed")
def seekable_round_trip(spark, sf_dir):
    """Written as seekable files and read back: every record, its place in its frame, and its frame's records. Frames are numbered by file there."""
    back = seekable.read_seekable(spark, written_events(spark, sf_dir))
    of_frame = back.groupBy("file_id", "frame_id").agg(F.count("*").alias("records"))
    return back.join(of_frame, ["file_id", "frame_id"]).select(F.md5("record").alias("record_md5"), "offset_in_frame", "records")


@query(f"""WITH RECURSIVE {EVENT_FRAMES}, f AS (SELECT CAST(sum(nbytes) AS BIGINT) AS bytes FROM framed GROUP BY frame_id)
SELECT count(*) AS frames, CAST(sum(bytes) AS BIGINT) AS decompressed, min(bytes) AS min_frame, max(bytes) AS max_frame, list_sort(list(bytes))[count(*) // 2 + 1] AS median_frame, CAST(0 AS BIGINT) AS bad_frames FROM f""")
def seekable_info(spark, sf_dir):
    out = written_events(spark, sf_dir)
    bad = seekable.verify_frames(spark, out).agg(F.count("*").alias("bad_frames")).withColumn("one", F.lit(1))
    about = seekable.info(spark, out).select("frames", "decompressed", "min_frame", "max_frame", "median_frame").withColumn("one", F.lit(1))
    return about.join(bad, "one").drop("one")  # one row each


def lines_sql(table: str, key: str, text: str) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY {key}) - 1 AS BIGINT) AS pos, {text} AS record FROM {table}"


@query(lines_sql("events", "event_id", "props"))
def jsonl_round_trip(spark, sf_dir):
    """Lines written in order, compressed by gzip, and read again by content. Records are bytes there; what was text is text again."""
    out = shared_path(spark, "lines")
    write_records(positioned(records.record_view(table(spark, sf_dir, "events"), "event_id", "props")), out, order="pos", compression="gzip")
    back = read_records(spark, f"{out}/part-*")
    return records.with_position(back, "file", "row").select("pos", F.col("record").cast("string").alias("record"))


@query("SELECT 'nation.parquet' AS file, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS row, n_name FROM nation")
def shard_projection(spark, sf_dir):
    return read_shards(spark, f"{sf_dir}/nation.parquet", ["n_name"])


def event_lines(spark, sf_dir) -> str:
    """Properties of events in files of lines."""
    out = shared_path(spark, "lines")
    write_records(positioned(records.record_view(table(spark, sf_dir, "events"), "event_id", "props")), out, order="pos")
    return f"{out}/part-*"


LINES = "lines AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, props AS record FROM events)"


@query(f"WITH {LINES} SELECT pos, md5(record) AS record_md5, CAST(sum(strlen(record) + 1) OVER (ORDER BY pos) - strlen(record) - 1 AS BIGINT) AS start FROM lines")
def file_records(spark, sf_dir):
    """Lines of files, read by byte ranges: positions and places by counting ranges, without moving a text."""
    read = units.records_of(units.units_of(spark, [event_lines(spark, sf_dir)], FRAME))
    return read.select("pos", F.md5("record").alias("record_md5"), "start")


@query(f"WITH {LINES}, perm AS (SELECT *, row_number() OVER (ORDER BY {sql_hex(SEED, 'perm', 0, 'pos')}, pos) - 1 AS out_pos FROM lines) SELECT pos, out_pos, md5(record) AS record_md5 FROM perm WHERE out_pos < 64")
def index_fetch_sample(spark, sf_dir):
    """The first records of a permutation, fetched from the byte ranges that hold them."""
    found = units.sample_of(units.units_of(spark, [event_lines(spark, sf_dir)], FRAME), 64, SEED)
    return found.select("pos", "out_pos", F.md5("record").alias("record_md5"))


@query(f"""WITH RECURSIVE {EVENT_FRAMES},
ids AS (SELECT DISTINCT frame_id FROM framed),
fp AS (SELECT frame_id, row_number() OVER (ORDER BY {sql_hex(SEED, 'perm', 0, 'frame_id')}, frame_id) - 1 AS frame_pos FROM ids),
rec AS (SELECT md5(record) AS record_md5, framed.frame_id, frame_pos, row_number() OVER (PARTITION BY framed.frame_id ORDER BY pos) - 1 AS rec FROM framed JOIN fp USING (frame_id) WHERE frame_pos % {WORLD} = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY {sql_hex(SEED, 'frame', 0, 'frame_id', 'rec')}, rec) - 1 AS rec_pos FROM rec)
SELECT CAST(frame_id AS BIGINT) AS frame_id, frame_pos, rec, rec_pos, row_number() OVER (ORDER BY frame_pos, rec_pos) - 1 AS out_pos, record_md5 FROM placed""")
def chunk_shuffled_files_rank(spark, sf_dir):
    """One rank's frames of seekable files, and no others, read and shuffled frame by frame."""
    planned = records.with_position(units.plan(spark, [written_events(spark, sf_dir)]), "file_id", "file", "part", name="unit")
    found = units.chunk_shuffled(planned, SEED, rank=0, world=WORLD)
    return found.select("frame_id", "frame_pos", "rec", "rec_pos", "out_pos", F.md5("record").alias("record_md5"))


@query("""WITH raw AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, encode(props) || CASE WHEN event_id % 3 = 0 THEN '\\xFF\\x0D\\x00\\xC3'::BLOB ELSE ''::BLOB END AS record FROM events)
SELECT via, pos, md5(record) AS record_md5, CAST(octet_length(record) + 1 AS BIGINT) AS nbytes FROM raw, (VALUES ('lines'), ('seekable')) AS v(via)""")
def byte_records(spark, sf_dir):
    """Records that aren't UTF-8, with carriage returns and zeros, through files of lines and seekable ones."""
    odd = F.concat(F.col("props").cast("binary"), F.when(F.col("event_id") % 3 == 0, F.unhex(F.lit("FF0D00C3"))).otherwise(F.unhex(F.lit(""))))
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), odd.alias("record"))
    placed = positioned(raw.withColumn("nbytes", (F.octet_length("record") + 1).cast("long")))
    as_lines, as_frames = shared_path(spark, "lines"), shared_path(spark, "seekable")
    write_records(placed, as_lines, order="pos")
    seekable.write_seekable(frames.assign_frames(placed, FRAME, in_order=True), as_frames)
    read = [units.records_of(units.units_of(spark, [path], FRAME)).withColumn("via", F.lit(via)) for via, path in (("lines", f"{as_lines}/part-*"), ("seekable", as_frames))]
    return read[0].unionByName(read[1]).select("via", "pos", F.md5("record").alias("record_md5"), "nbytes")


CUT = 10_000


@query(f"""WITH doc AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, replace(coalesce(text, ''), chr(10), ' ') AS record FROM documents)
SELECT pos, md5(record) AS record_md5, CAST(sum(strlen(record) + 1) OVER (ORDER BY pos) - strlen(record) - 1 AS BIGINT) AS start FROM doc""")
def cut_frames_round_trip(spark, sf_dir):
    """Documents as records of seekable files whose frames end inside records, read frame by frame. Texts' own line feeds are blanks here."""
    out = shared_path(spark, "cut")
    seekable.write_cut(positioned(documents(spark, sf_dir).select("id", F.translate("record", "\n", " ").alias("record"))), out, CUT, in_order=True)
    read = units.records_of(units.units_of(spark, [out]))
    return read.select("pos", F.md5("record").alias("record_md5"), "start")
