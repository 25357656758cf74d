"""Ingest queries: normal form, corroboration, reconciliation, occurrences, notes, scanners, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import text
from tallywright.operators import fts, identity, reconcile as rec, scan
from tallywright.plans.registry import query
from tallywright.sources import feed, store
from tallywright.sources.ledger import Ledger


def stored(L: Ledger) -> DataFrame:
    """The ledger, amounts made coarse so that contents repeat; repeats of a content are numbered."""
    rows = L.transactions.withColumn("amount_minor", F.expr("amount_minor div 1000000"))
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(identity.identity()).orderBy("row_id")) - 1)


def fetched(L: Ledger) -> DataFrame:
    """The same rows as a later fetch has them: dates moved by 0 to 4 days, some amounts, states and references changed; every ninth row is missing and a new one in its place."""
    key = F.col("row_id")
    rows = L.transactions.withColumn("amount_minor", F.expr("amount_minor div 1000000"))
    return rows.select(
        key.cast("int").alias("fetch_idx"), "account_id", F.date_format(F.date_add(text.strict_date(F.col("booking_date")), (key % 5).cast("int")), "yyyy-MM-dd").alias("booking_date"),
        F.when(key % 12 == 5, F.col("amount_minor") + 1).otherwise(F.col("amount_minor")).alias("amount_minor"), "currency", "direction",
        F.when(key % 3 == 0, "BOOK").otherwise(F.col("status")).alias("status"), "counterparty", F.when(key % 9 == 4, F.concat(F.lit("new "), key.cast("string"))).otherwise(F.col("remittance")).alias("remittance"),
        F.when(key % 9 != 4, F.col("provider_ref")).alias("provider_ref"),
    )


def _trust(L: Ledger) -> DataFrame:
    return L.accounts.select("account_id", (F.col("account_id") % 2 == 0).alias("ref_stable"), F.lit("account").alias("ref_scope"))


def _actions(L: Ledger, interval=None) -> DataFrame:
    return rec.reconcile(stored(L), fetched(L), _trust(L), interval=interval)


@query()
def reconcile(L: Ledger):
    return _actions(L)


@query("transactions", """
    WITH t AS (SELECT *, row_id % 12 AS d, CASE WHEN row_id % 3 = 0 THEN 'BOOK' ELSE status END AS now, state = 'active' AND row_id % 12 <= 7 AND row_id % 12 <> 5 AND row_id % 9 <> 4 AS paired
               FROM transactions WHERE regexp_full_match(booking_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(booking_date AS DATE) IS NOT NULL)
    SELECT account_id, 'insert' AS op, NULL::BIGINT AS row_id, row_id::INTEGER AS fetch_idx, CASE WHEN d = 5 OR row_id % 9 = 4 THEN 0 ELSE 1 END AS occurrence, CASE WHEN paired THEN 'windowed' ELSE 'inserted' END AS method,
           CASE WHEN paired THEN round(1 - d / 8, 3) ELSE 1 END::DOUBLE AS confidence, paired AND needs_review AS needs_review, CASE WHEN paired AND needs_review THEN review_reason END AS reason FROM t WHERE NOT paired OR (status <> 'BOOK' AND now = 'BOOK')
    UNION ALL SELECT account_id, 'supersede', row_id, NULL, NULL, 'windowed', round(1 - d / 8, 3), needs_review, CASE WHEN needs_review THEN review_reason END FROM t WHERE paired AND status <> 'BOOK' AND now = 'BOOK'
    UNION ALL SELECT account_id, 'update', row_id, row_id::INTEGER, 0, 'windowed', round(1 - d / 8, 3), false, NULL FROM t WHERE paired AND NOT (status <> 'BOOK' AND now = 'BOOK') AND d > 0""")
def reconcile_plain(L: Ledger):
    """The whole ledger with contents that don't repeat and references that aren't trusted, where what is due can be said in SQL; dates move by up to 11 days."""
    key = F.col("row_id")
    rows = L.transactions.withColumn("remittance", F.concat(F.lit("row "), key.cast("string")))
    moved = F.date_format(F.date_add(text.strict_date(F.col("booking_date")), (key % 12).cast("int")), "yyyy-MM-dd")
    later = rows.select(
        key.cast("int").alias("fetch_idx"), "account_id", moved.alias("booking_date"), F.when(key % 12 == 5, F.col("amount_minor") + 1).otherwise(F.col("amount_minor")).alias("amount_minor"), "currency", "direction",
        F.when(key % 3 == 0, "BOOK").otherwise(F.col("status")).alias("status"), "counterparty", F.when(key % 9 == 4, F.concat(F.lit("new "), key.cast("string"))).otherwise(F.col("remittance")).alias("remittance"), "provider_ref",
    )
    trust = L.accounts.select("account_id", F.lit(False).alias("ref_stable"), F.lit("account").alias("ref_scope"))
    found = rec.reconcile(rows.withColumn("occurrence", F.lit(0)), later, trust)
    return found.select("account_id", "op", "row_id", "fetch_idx", "occurrence", "method", "confidence", "needs_review", "reason")


@query("transactions", "SELECT row_id, booking_date FROM transactions WHERE NOT coalesce(regexp_full_match(booking_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(booking_date AS DATE) IS NOT NULL, false)")
def reconcile_unsound(L: Ledger):
    """Rows that are reported instead of matched."""
    return rec.unsound(L.transactions).select("row_id", "booking_date")


@query()
def reconcile_reference(L: Ledger):
    return _actions(L).filter(F.col("method").startswith("reference") | (F.col("reason") == "provider_ref_reuse"))


@query()
def reconcile_windowed(L: Ledger):
    return _actions(L).filter("method = 'windowed'")


@query()
def windowed_match(L: Ledger):
    return _actions(L).filter("method = 'windowed' AND op IN ('update', 'supersede')").select("account_id", "row_id", "confidence", "needs_review")


@query()
def supersede(L: Ledger):
    return _actions(L).filter("op = 'supersede'")


@query()
def tombstones(L: Ledger):
    """Off in production; here over an interval that is proven whole."""
    return _actions(L, interval=(9_500, 11_000)).filter("op = 'tombstone'").select("account_id", "row_id", "reason")


@query()
def occurrence_alloc(L: Ledger):
    return _actions(L).filter("occurrence IS NOT NULL").select("account_id", "identity_key", "occurrence", "op")


@query()
def ingest_stats(L: Ledger):
    return _actions(L).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("needs_review")).alias("in_review"))


@query("transactions", "SELECT account_id, status, max(n) AS next FROM (SELECT account_id, status, count(*) AS n FROM transactions GROUP BY 1, 2 UNION ALL SELECT account_id, 'BOOK', 3 FROM transactions WHERE account_id % 2 = 0) GROUP BY 1, 2")
def occurrence_high_water(L: Ledger):
    """The next free occurrence by cluster: the larger of what the rows hold and what was ever issued."""
    held = L.transactions.groupBy("account_id", "status").agg(F.count(F.lit(1)).alias("n"))
    issued = L.transactions.filter("account_id % 2 = 0").select("account_id", F.lit("BOOK").alias("status"), F.lit(3).cast("long").alias("n"))
    return held.unionByName(issued).groupBy("account_id", "status").agg(F.max("n").alias("next"))


PAIRS = """
    s AS (SELECT *, amount_minor // 10000000 AS minor, CAST(booking_date AS DATE) AS d, nullif(lower(trim(regexp_replace(counterparty, '\\s+', ' ', 'g'))), '') AS party FROM transactions WHERE provider_ref IS NOT NULL AND booking_date <> '2024-2-30'),
    p AS (SELECT a.row_id AS stored_id, b.row_id AS fetched_id, abs(a.d - b.d) <= 3 AS near, a.minor AS am, b.minor AS bm, a.party AS ap, b.party AS bp, a.direction AS ad, b.direction AS bd, a.currency AS ac, b.currency AS bc
          FROM s a JOIN s b ON a.account_id % 10 = b.account_id % 10 AND a.provider_ref = b.provider_ref AND a.row_id < b.row_id)"""


def _pairs(L: Ledger, prepared) -> DataFrame:
    """Rows that share a reference, each pair once. There are as many as the square of a reference's rows, so texts are prepared before the join."""
    rows = L.transactions.filter("provider_ref IS NOT NULL AND booking_date <> '2024-2-30'").withColumn("d", F.to_date("booking_date")).withColumn("amount_minor", F.expr("amount_minor div 10000000")).withColumn("k", F.col("account_id") % 10)
    rows = prepared(rows)
    s, f = rows.alias("s"), rows.alias("f")
    return s.join(f, (F.col("s.k") == F.col("f.k")) & (F.col("s.provider_ref") == F.col("f.provider_ref")) & (F.col("s.row_id") < F.col("f.row_id")))


@query("transactions", f"WITH {PAIRS} SELECT stored_id, fetched_id, CASE WHEN near AND am = bm THEN 'reference' WHEN near AND coalesce(ap = bp, false) THEN 'reference_corroborated' ELSE 'rejected' END AS verdict FROM p")
def corroborate(L: Ledger):
    return _pairs(L, identity.with_party).select(F.col("s.row_id").alias("stored_id"), F.col("f.row_id").alias("fetched_id"), identity.corroborated("s", "f", canonical=True).alias("verdict"))


@query("transactions", f"WITH {PAIRS} SELECT stored_id, fetched_id, CASE WHEN ad IS DISTINCT FROM bd OR ac IS DISTINCT FROM bc THEN 'direction_or_currency_changed' WHEN am <> bm THEN 'amount_changed' END AS change FROM p")
def money_change(L: Ledger):
    return _pairs(L, identity.with_units).select(F.col("s.row_id").alias("stored_id"), F.col("f.row_id").alias("fetched_id"), identity.money_change("s", "f", canonical=True).alias("change"))


def _payload(L: Ledger) -> DataFrame:
    key, text = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return L.table("orders").select(
        key.alias("fetch_idx"), F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("E"), key.cast("string"))).alias("entry_reference"), F.when(key % 5 != 0, F.concat(F.lit("T"), key.cast("string"))).alias("transaction_id"),
        F.when(key % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("booking_date"), F.when(key % 8 != 0, F.lit("2024-01-05")).alias("value_date"),
        F.struct(F.when(key % 11 == 0, "EURO").otherwise("EUR").alias("currency"), F.when(key % 7 == 0, F.concat(F.lit("-"), text)).when(key % 13 == 0, F.concat(text, F.lit("1"))).otherwise(text).alias("amount")).alias("transaction_amount"),
        F.when(key % 17 == 0, "XXXX").when(key % 2 == 0, "DBIT").otherwise("CRDT").alias("credit_debit_indicator"), F.col("o_orderstatus").alias("status"),
        F.struct(F.concat(F.lit("Shop "), (key % 9).cast("string")).alias("name")).alias("creditor"), F.struct(F.lit("Payer").alias("name")).alias("debtor"),
        F.when(key % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.col("o_orderpriority"))).alias("remittance_information"),
    )


@query("", """
    WITH p AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS pri, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
    m AS (SELECT *, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN -cents WHEN k % 13 = 0 THEN NULL ELSE cents END AS minor,
                 coalesce(CASE WHEN k % 4 <> 0 THEN day END, CASE WHEN k % 8 <> 0 THEN '2024-01-05' END) AS booked FROM p)
    SELECT k AS fetch_idx, booked AS booking_date, CASE WHEN k % 8 <> 0 THEN '2024-01-05' END AS value_date, minor AS amount_minor, CASE WHEN k % 11 = 0 THEN 'EURO' ELSE 'EUR' END AS currency,
           CASE WHEN k % 17 = 0 THEN 'XXXX' WHEN k % 2 = 0 THEN 'DBIT' ELSE 'CRDT' END AS direction, status, CASE WHEN k % 17 <> 0 AND k % 2 = 0 THEN 'Shop ' || (k % 9) ELSE 'Payer' END AS counterparty,
           CASE WHEN k % 6 <> 0 THEN 'a ' || pri END AS remittance, CASE WHEN k % 3 = 1 THEN 'E' || k WHEN k % 5 <> 0 THEN 'T' || k END AS provider_ref,
           CASE WHEN k % 3 = 1 THEN 'entry_reference' WHEN k % 5 <> 0 THEN 'transaction_id' END AS provider_ref_kind,
           CASE WHEN minor IS NULL THEN 'amount' WHEN k % 17 = 0 THEN 'direction' WHEN minor < 0 THEN 'negative' WHEN booked IS NULL THEN 'date' END AS error FROM m""")
def normalise(L: Ledger):
    return feed.normalise(_payload(L))


TERMS = """
    t AS (SELECT note_id, list_filter(regexp_split_to_array(lower(coalesce(note, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM notes),
    s AS (SELECT count(*) AS notes, avg(len(w)) AS mean FROM t),
    q AS (SELECT note_id, term, len(list_filter(w, lambda x: x = term)) AS times, len(w) AS length FROM t, (VALUES ('the'), ('reth')) v(term) WHERE list_contains(w, term)),
    d AS (SELECT term, count(*) AS df FROM q GROUP BY 1)"""


@query("notes", f"""
    WITH {TERMS} SELECT note_id, round(sum(ln(1 + (notes - df + 0.5) / (df + 0.5)) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
    FROM q JOIN d USING (term), s WHERE note_id NOT IN (SELECT note_id FROM t WHERE list_contains(w, 'der')) GROUP BY note_id HAVING count(*) = 2""")
def notes_match(L: Ledger):
    return fts.match(L.notes, ["the", "reth"], ["der"]).withColumn("score", F.round("score", 6))


@query("notes", f"""
    WITH {TERMS}, found AS (SELECT note_id, round(sum(ln(1 + (notes - df + 0.5) / (df + 0.5)) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
        FROM q JOIN d USING (term), s GROUP BY note_id HAVING count(*) = 2)
    SELECT row_id, note_id, score FROM (SELECT row_id, note_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, note_id) AS k FROM found JOIN notes USING (note_id)) WHERE k = 1""")
def notes_best(L: Ledger):
    return fts.best(L.notes, fts.match(L.notes, ["the", "reth"]).withColumn("score", F.round("score", 6)))


@query("notes", "SELECT note_id FROM notes WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(note, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ', ' of the ')")
def notes_phrase(L: Ledger):
    return fts.phrase(L.notes, ["of", "the"])


@query()
def notes_search(L: Ledger):
    """Boolean query over stemmed words."""
    return fts.search(L.notes, '"the reth" OR thing* NOT der')


@query("", """
    SELECT doc_id, 'DE' || lpad((98 - (body || '131400')::HUGEINT % 97)::VARCHAR, 2, '0') || body AS number
    FROM (SELECT doc_id, lpad(doc_id::VARCHAR, 18, '37') AS body FROM documents WHERE doc_id % 10 = 0)""")
def scan_identifiers(L: Ledger):
    """All documents; every tenth has a number at its end, plain, in groups or behind escapes."""
    key = F.col("doc_id")
    body = F.lpad(key.cast("string"), 18, "37")
    check = (98 - F.concat(body, F.lit("131400")).cast("decimal(24,0)") % 97).cast("int")
    number = F.concat(F.lit("DE"), F.lpad(check.cast("string"), 2, "0"), body)
    groups = F.array_join(F.regexp_extract_all(number, F.lit("(.{1,4})"), F.lit(1)), " ")
    hidden = F.when(key % 30 == 0, number).when(key % 30 == 10, groups).otherwise(F.concat(F.lit("\\x44"), F.substring(number, 2, 99)))
    planted = F.when(key % 10 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\n; "), hidden)).otherwise(F.col("text"))
    return scan.scan_numbers(L.table("documents").select("doc_id", planted.alias("text")), "doc_id", "text")


@query("", "SELECT ['severity', 'ruling', 'decision_code', 'private_spec'][doc_id % 5] AS category, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1")
def categorize_lines(L: Ledger):
    """All documents; four in five end in a line of a known category."""
    ends = F.array(*[F.lit(t) for t in ("an ordinary line", "P0 first", "round 2 ruling", "finding E12", "\u00a78.1")])
    planted = F.concat_ws("\n", "text", F.element_at(ends, (F.col("doc_id") % 5 + 1).cast("int")))
    return scan.lines(L.table("documents").select("doc_id", planted.alias("text")), "doc_id", "text").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 2 DAY AS DATE) FROM events) GROUP BY ALL")
def stream_daily_totals(L: Ledger):
    """A stream run to its end: days that the watermark has closed."""
    from tallywright.streaming.windows import daily_totals, run_to_end

    spark = L.spark
    top = f"{store.shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    schema = L.table("events").select("ts", "event_type").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(L.dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    run_to_end(daily_totals(events), f"{top}/out", f"{top}/state")
    return spark.read.parquet(f"{top}/out")
