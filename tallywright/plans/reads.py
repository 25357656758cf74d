"""Read queries: listings, tags, balances, spend, notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.functions import money, text
from tallywright.operators import aggregate, reads
from tallywright.plans.registry import query
from tallywright.sources.ledger import AS_OF, Ledger

LIVE = "state IN ('active', 'vanished')"
SIGNED = "CASE WHEN upper(coalesce(direction, '')) = 'DBIT' THEN -coalesce(amount_minor, 0) ELSE coalesce(amount_minor, 0) END"
GOOD = "coalesce(regexp_full_match(currency, '\\p{L}{3}'), false)"
STATE = """CASE WHEN bool_or(tag = 'unclassifiable') THEN 'terminal' WHEN bool_or(tag = 'awaiting-operator') THEN 'parked'
           WHEN bool_or(tag NOT IN ('awaiting-operator', 'unclassifiable')) THEN 'classified' ELSE 'workable' END"""


@query("transactions tags accounts", f"""
    WITH live AS (SELECT row_id, upper(currency) AS currency, {SIGNED} AS v FROM transactions
                  WHERE {LIVE} AND {GOOD} AND account_id IN (SELECT account_id FROM accounts WHERE included))
    SELECT tag, currency, sum(v)::BIGINT AS total_minor, count(*) AS n FROM live JOIN (SELECT DISTINCT * FROM tags) USING (row_id) GROUP BY ALL
    UNION ALL
    SELECT '(untagged)', currency, sum(v)::BIGINT, count(*) FROM live WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.row_id = live.row_id) GROUP BY ALL""")
def spend_by_tag(L: Ledger):
    rows = reads.in_scope(reads.listed(L.transactions), L.accounts)
    return aggregate.spend_by_tag(rows, L.tags)


@query("transactions tags", f"""
    SELECT upper(currency) AS currency, sum({SIGNED})::BIGINT AS total_minor, count(*) AS n FROM transactions t
    WHERE {LIVE} AND {GOOD} AND row_id NOT IN (SELECT row_id FROM tags) GROUP BY ALL""")
def spend_untagged(L: Ledger):
    return aggregate.spend_by_tag(reads.listed(L.transactions), L.tags).filter(F.col("tag") == aggregate.UNTAGGED).drop("tag")


@query("transactions", f"SELECT count(*) FILTER (NOT {GOOD}) AS n FROM transactions WHERE {LIVE}")
def bad_currency_rows(L: Ledger):
    return aggregate.bad_currency(reads.listed(L.transactions))


@query("transactions tags", "SELECT tag, count(*) AS n FROM tags JOIN transactions USING (row_id) WHERE state <> 'superseded' GROUP BY tag ORDER BY n DESC, tag LIMIT 200")
def list_tags(L: Ledger):
    return aggregate.tag_usage(L.transactions, L.tags)


@query("transactions tags", "SELECT count(DISTINCT tag) AS tags FROM tags JOIN transactions USING (row_id) WHERE state <> 'superseded'")
def tag_total(L: Ledger):
    return aggregate.tag_total(L.transactions, L.tags)


@query("transactions", f"""
    WITH g AS (SELECT 'ref-' || (row_id % 300) AS tag, upper(currency) AS currency, sum({SIGNED})::BIGINT AS total_minor, count(*) AS n FROM transactions WHERE {LIVE} AND {GOOD} GROUP BY ALL)
    SELECT *, greatest((SELECT count(*) FROM g) - 200, 0) AS omitted FROM g ORDER BY currency, abs(total_minor) DESC, tag LIMIT 200""")
def spend_listing(L: Ledger):
    """Three hundred tags: more groups than a listing shows."""
    tags = L.transactions.select("row_id", F.concat(F.lit("ref-"), (F.col("row_id") % 300).cast("string")).alias("tag"))
    return aggregate.spend_listing(aggregate.spend_by_tag(reads.listed(L.transactions), tags))


@query("transactions", f"SELECT row_id, {SIGNED} AS signed_minor FROM transactions")
def signed_amount(L: Ledger):
    return L.transactions.select("row_id", money.signed(F.col("amount_minor"), F.col("direction")).alias("signed_minor"))


@query("transactions", """
    SELECT row_id, CASE length(currency) WHEN 3 THEN CASE currency WHEN 'JPY' THEN amount_minor::VARCHAR
        WHEN 'BHD' THEN (amount_minor // 1000) || '.' || lpad((amount_minor % 1000)::VARCHAR, 3, '0') ELSE (amount_minor // 100) || '.' || lpad((amount_minor % 100)::VARCHAR, 2, '0') END END AS shown
    FROM transactions""")
def money_format(L: Ledger):
    return L.transactions.select("row_id", money.format_minor(F.col("amount_minor"), F.col("currency")).alias("shown"))


@query("", """
    WITH t AS (SELECT l_orderkey * 8 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN 'JPY' WHEN 1 THEN 'BHD' WHEN 2 THEN 'EUR' ELSE 'E1R' END AS currency,
                      CASE WHEN l_orderkey % 17 = 0 THEN '1e3' WHEN l_orderkey % 19 = 0 THEN '' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS txt FROM lineitem),
    n AS (SELECT *, CASE WHEN regexp_full_match(txt, '[0-9]+\\.[0-9]*') THEN TRY_CAST(txt AS DECIMAL(38,9)) END * CASE currency WHEN 'JPY' THEN 1 WHEN 'BHD' THEN 1000 ELSE 100 END AS x FROM t)
    SELECT id, txt, currency, CASE WHEN currency <> 'E1R' AND x = floor(x) THEN CAST(x AS BIGINT) END AS minor FROM n""")
def money_parse(L: Ledger):
    key = F.col("l_linenumber") % 4
    rows = L.table("lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_orderkey") % 17 == 0, "1e3").when(F.col("l_orderkey") % 19 == 0, "").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("txt"),
        F.when(key == 0, "JPY").when(key == 1, "BHD").when(key == 2, "EUR").otherwise("E1R").alias("currency"),
    )
    return rows.withColumn("minor", money.to_minor(F.col("txt"), F.col("currency")))


@query("transactions", f"SELECT row_id, account_id, booking_date, amount_minor, currency, direction, count(*) OVER () > 50 AS has_more FROM transactions WHERE {LIVE} AND booking_date >= '1999-01-01' AND booking_date < '2000-01-01' AND amount_minor BETWEEN 1000000 AND 30000000 AND direction = 'DBIT' ORDER BY row_id DESC LIMIT 50")
def list_transactions(L: Ledger):
    rows = reads.listed(L.transactions).filter("booking_date >= '1999-01-01' AND booking_date < '2000-01-01' AND amount_minor BETWEEN 1000000 AND 30000000 AND direction = 'DBIT'")
    return reads.shown(rows.select("row_id", "account_id", "booking_date", "amount_minor", "currency", "direction"), "row_id", 50)


@query("transactions", f"SELECT count(*) AS listed, count(*) FILTER (booking_date >= '1999-01-01') AS in_range, count(*) FILTER (needs_review) AS in_review FROM transactions WHERE {LIVE}")
def listing_disclosure(L: Ledger):
    return reads.listed(L.transactions).agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.expr("booking_date >= '1999-01-01'")).alias("in_range"), F.count_if(F.expr("needs_review")).alias("in_review"))


@query("accounts", "SELECT category, count(*) FILTER (included) AS included, count(*) FILTER (NOT included) AS excluded FROM accounts GROUP BY category")
def included_accounts(L: Ledger):
    return L.accounts.groupBy("category").agg(F.count_if(F.expr("included")).alias("included"), F.count_if(F.expr("NOT included")).alias("excluded"))


@query("coverage", f"""SELECT coalesce(min("start"), DATE '1970-01-01') AS "from", DATE '{AS_OF}' + 1 AS "to" FROM coverage""")
def effective_range(L: Ledger):
    return L.coverage.agg(F.coalesce(F.min("start"), F.lit("1970-01-01").cast("date")).alias("from")).withColumn("to", F.date_add(F.lit(AS_OF).cast("date"), 1))


@query("transactions", f"SELECT row_id FROM transactions WHERE {LIVE} AND (lower(counterparty) LIKE '%e  1_ g%' OR lower(remittance) LIKE '%urgent ref_5%')")
def text_search(L: Ledger):
    found = lambda c, p: F.coalesce(text.contains(F.col(c), F.lit(p)), F.lit(False))
    return reads.listed(L.transactions).filter(found("counterparty", "E  1_ g") | found("remittance", "URGENT ref_5")).select("row_id")


@query("transactions tags", f"SELECT row_id FROM transactions WHERE {LIVE} AND row_id IN (SELECT row_id FROM tags WHERE tag = 'groceries') AND row_id IN (SELECT row_id FROM tags WHERE tag = 'household')")
def tags_all(L: Ledger):
    return reads.tagged_all(reads.listed(L.transactions), L.tags, ["groceries", "household"]).select("row_id")


@query("transactions tags", f"SELECT row_id FROM transactions WHERE {LIVE} AND row_id IN (SELECT row_id FROM tags WHERE tag IN ('groceries', 'travel'))")
def tags_any(L: Ledger):
    return reads.tagged_any(reads.listed(L.transactions), L.tags, ["groceries", "travel"]).select("row_id")


@query("transactions tags", f"SELECT row_id FROM transactions t WHERE {LIVE} AND NOT EXISTS (SELECT 1 FROM tags g WHERE g.row_id = t.row_id AND g.tag IN ('groceries', 'travel'))")
def tags_none(L: Ledger):
    return reads.tagged_none(reads.listed(L.transactions), L.tags, ["groceries", "travel"]).select("row_id")


@query("transactions tags", f"SELECT row_id, {STATE} AS classification FROM transactions LEFT JOIN tags USING (row_id) WHERE {LIVE} GROUP BY row_id")
def classification_state(L: Ledger):
    return reads.states(reads.listed(L.transactions), L.tags)


@query("transactions tags", f"SELECT count(*) FILTER (c = 'workable') AS workable, count(*) FILTER (c = 'parked') AS parked FROM (SELECT row_id, {STATE} AS c FROM transactions LEFT JOIN tags USING (row_id) WHERE {LIVE} GROUP BY row_id)")
def queue_totals(L: Ledger):
    return reads.states(reads.listed(L.transactions), L.tags).agg(F.count_if(F.expr("classification = 'workable'")).alias("workable"), F.count_if(F.expr("classification = 'parked'")).alias("parked"))


@query("transactions tags", f"SELECT row_id, classification, booking_date FROM (SELECT row_id, any_value(booking_date) AS booking_date, {STATE} AS classification FROM transactions LEFT JOIN tags USING (row_id) WHERE {LIVE} GROUP BY row_id) WHERE classification IN ('workable', 'parked')")
def classification_queue(L: Ledger):
    return reads.queue(L.transactions, L.tags).select("row_id", "classification", "booking_date")


@query("transactions tags", f"SELECT row_id, classification, count(*) OVER () > 100 AS has_more FROM (SELECT row_id, {STATE} AS classification FROM transactions LEFT JOIN tags USING (row_id) WHERE {LIVE} AND row_id < 9000 GROUP BY row_id) WHERE classification IN ('workable', 'parked') ORDER BY row_id DESC LIMIT 100")
def queue_page(L: Ledger):
    return reads.shown(reads.queue(L.transactions, L.tags).select("row_id", "classification"), "row_id", 100, before=9000)


@query("balances", """
    SELECT account_id, balance_type, amount_minor, currency, amount_minor IS NOT NULL AND currency <> '' AS usable FROM (
        SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY CASE balance_type WHEN 'CLBD' THEN 0 WHEN 'ITBD' THEN 1 WHEN 'ITAV' THEN 2 WHEN 'XPCD' THEN 3 ELSE 4 END, seq) AS n FROM balances) WHERE n = 1""")
def balances(L: Ledger):
    return reads.pick_balance(L.balances).select("account_id", "balance_type", "amount_minor", "currency", reads.usable_balance().alias("usable"))


@query("balances accounts", """
    WITH picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY CASE balance_type WHEN 'CLBD' THEN 0 WHEN 'ITBD' THEN 1 WHEN 'ITAV' THEN 2 WHEN 'XPCD' THEN 3 ELSE 4 END, seq) AS n FROM balances) WHERE n = 1),
    seen AS (SELECT CASE WHEN p.amount_minor IS NOT NULL AND p.currency <> '' THEN p.currency END AS currency, p.amount_minor FROM accounts a LEFT JOIN picked p USING (account_id) WHERE a.included)
    SELECT currency, CASE WHEN currency IS NULL THEN NULL ELSE sum(amount_minor)::BIGINT END AS total_minor, count(*) AS accounts FROM seen GROUP BY currency""")
def balance_total(L: Ledger):
    """One row per currency; accounts without a usable balance are counted under a null currency, never converted."""
    picked = reads.pick_balance(L.balances).filter(reads.usable_balance()).select("account_id", F.col("currency").alias("of"), "amount_minor")
    seen = L.accounts.filter("included").select("account_id").join(picked, "account_id", "left")
    return seen.groupBy(F.col("of").alias("currency")).agg(F.sum("amount_minor").alias("total_minor"), F.count(F.lit(1)).alias("accounts"))


@query("transactions", f"""
    WITH c AS (SELECT review_reason, count(*) AS n, review_reason IN ('amount_changed', 'direction_or_currency_changed') AS money FROM transactions WHERE {LIVE} AND needs_review GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY money ORDER BY n DESC, review_reason) AS k FROM c)
    SELECT CASE WHEN money OR k <= 2 THEN review_reason ELSE '(other)' END AS reason, sum(n)::BIGINT AS n, count(*) AS reasons FROM r GROUP BY 1""")
def review_reasons(L: Ledger):
    return reads.reason_counts(reads.listed(L.transactions), named=2)


@query("notes", """SELECT row_id, note_id, author, length(note) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY note_id DESC) AS k FROM notes) WHERE k <= 20""")
def notes_latest(L: Ledger):
    return reads.latest(L.notes).select("row_id", "note_id", "author", F.char_length("note").cast("long").alias("chars"))


@query("transactions tags notes", """
    SELECT t.row_id, t.booking_date, t.amount_minor, g.tags, coalesce(n.notes, 0) AS notes, n.latest_note FROM transactions t
    LEFT JOIN (SELECT row_id, string_agg(tag, ' ' ORDER BY tag) AS tags FROM tags GROUP BY 1) g USING (row_id)
    LEFT JOIN (SELECT row_id, count(*) AS notes, max(note_id) AS latest_note FROM notes GROUP BY 1) n USING (row_id)""")
def get_transaction(L: Ledger):
    """What a lookup shows of a row, for all rows."""
    tags = L.tags.groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"))
    notes = L.notes.groupBy("row_id").agg(F.count(F.lit(1)).alias("notes"), F.max("note_id").alias("latest_note"))
    return L.transactions.select("row_id", "booking_date", "amount_minor").join(tags, "row_id", "left").join(notes, "row_id", "left").withColumn("notes", F.coalesce("notes", F.lit(0)))


@query("transactions", "SELECT account_id, booking_date, row_id, amount_minor, currency, direction, status, state FROM transactions")
def export_history(L: Ledger):
    """What the CSV and JSON-lines sinks write: all columns but the raw payload, ordered by account, date and row."""
    return L.transactions.select("account_id", "booking_date", "row_id", "amount_minor", "currency", "direction", "status", "state").orderBy("account_id", "booking_date", "row_id")


@query("sync_state", f"""
    WITH t AS (SELECT *, epoch(TIMESTAMP '{AS_OF} 00:00:00') - epoch(strptime(replace(last_success_at, 'Z', ''), '%Y-%m-%dT%H:%M:%S')) AS age FROM sync_state)
    SELECT account_id, CASE WHEN age IS NULL THEN NULL WHEN greatest(age, 0) >= 3600 THEN (greatest(age, 0)::BIGINT // 3600) || 'h ' || ((greatest(age, 0)::BIGINT % 3600) // 60) || 'm' ELSE (greatest(age, 0)::BIGINT // 60) || 'm' END AS age,
           CASE WHEN age IS NULL THEN 'never' WHEN age > 21600 THEN 'stale' ELSE 'fresh' END AS freshness, completeness FROM t""")
def freshness(L: Ledger):
    age = F.unix_timestamp(F.lit(f"{AS_OF} 00:00:00").cast("timestamp")) - F.unix_timestamp(text.instant(F.col("last_success_at")))
    rows = L.sync_state.withColumn("s", age)
    left = F.greatest("s", F.lit(0))
    shown = F.when(left >= 3600, F.concat(F.floor(left / 3600).cast("string"), F.lit("h "), F.floor(left % 3600 / 60).cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(left / 60).cast("string"), F.lit("m")))
    state = F.when(F.col("s").isNull(), "never").when(F.col("s") > 21600, "stale").otherwise("fresh")
    return rows.select("account_id", F.when(F.col("s").isNotNull(), shown).alias("age"), state.alias("freshness"), "completeness")


@query("transactions", """SELECT row_id, CASE WHEN booking_date ~ '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' THEN TRY_CAST(booking_date AS DATE) END AS booked FROM transactions""")
def strict_dates(L: Ledger):
    return L.transactions.select("row_id", text.strict_date(F.col("booking_date")).alias("booked"))


@query("notes", """
    SELECT note_id, CASE WHEN length(flat) > 256 THEN left(flat, 256) || '...(clipped from ' || length(flat) || ' chars)' ELSE flat END AS shown
    FROM (SELECT note_id, regexp_replace(replace(replace(coalesce(note, ''), 'the ', '[fence-open removed]'), ' of', '[fence-close removed]'), '\\r\\n|\\n|\\r', ' ', 'g') AS flat FROM notes)""")
def neutralize_text(L: Ledger):
    return L.notes.select("note_id", text.neutral(F.col("note"), "the ", " of").alias("shown"))


@query("", "SELECT c_custkey AS account_id, CASE WHEN length(iban) > 8 THEN left(iban, 4) || '…' || right(iban, 4) ELSE iban END AS masked FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, '#', '') ELSE left(c_name, 6) END AS iban FROM customer)")
def mask_iban(L: Ledger):
    iban = F.when(F.col("c_custkey") % 2 == 0, F.replace("c_name", F.lit("#"), F.lit(""))).otherwise(F.left("c_name", F.lit(6)))
    return L.table("customer").select(F.col("c_custkey").alias("account_id"), text.mask_iban(iban).alias("masked"))


@query("accounts", """
    WITH k AS (SELECT account_id, encode(upper(trim(name)) || '|' || currency) AS m FROM accounts)
    SELECT account_id, sha256(unhex(repeat('5C', 64)::VARCHAR)::BLOB || unhex(sha256(unhex(repeat('36', 64))::BLOB || m))) AS account_key FROM k""")
def account_key(L: Ledger):
    return L.accounts.select("account_id", text.account_key(b"", F.col("name"), F.col("currency")).alias("account_key"))


@query("", "SELECT 'BANK' || (c_nationkey % 7) AS aspsp, n_name AS country, psu AS psu_type, max((c_custkey % 180) * 86400) // 86400 AS consent_days FROM customer JOIN nation ON n_nationkey = c_nationkey, (VALUES ('personal'), ('business')) v(psu) GROUP BY ALL")
def list_banks(L: Ledger):
    found = L.table("customer").join(L.table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    catalogue = found.groupBy(F.concat(F.lit("BANK"), (F.col("c_nationkey") % 7).cast("string")).alias("aspsp"), F.col("n_name").alias("country")).agg(F.max(F.col("c_custkey") % 180 * 86400).alias("seconds"))
    return catalogue.select("aspsp", "country", F.explode(F.array(F.lit("personal"), F.lit("business"))).alias("psu_type"), F.expr("seconds div 86400").alias("consent_days"))
