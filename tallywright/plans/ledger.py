"""Interval, trust, rule, annotation, refresh and erasure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.functions import text
from tallywright.operators import accounts, annotate, erase, intervals, reads, refresh, rules, trust
from tallywright.plans.registry import query
from tallywright.sources import feed
from tallywright.sources.ledger import AS_OF, Ledger

LIVE = "state IN ('active', 'vanished')"
FROM, TO = "2024-01-01", AS_OF
MERGED = """
    m AS (SELECT account_id, min("start") AS "start", max("end") AS "end" FROM (
        SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT *, max("end") OVER (PARTITION BY account_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM coverage))
        GROUP BY account_id, island)"""


@query("coverage", f"WITH {MERGED} SELECT * FROM m")
def coverage_merge(L: Ledger):
    return intervals.merge(L.coverage)


@query("coverage accounts", f"""
    WITH {MERGED}, days AS (SELECT unnest(generate_series(DATE '{FROM}', DATE '{TO}' - 1, INTERVAL 1 DAY))::DATE AS d),
    bare AS (SELECT account_id, d, d - (row_number() OVER (PARTITION BY account_id ORDER BY d))::INTEGER AS run FROM accounts, days
             WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.account_id = accounts.account_id AND m."start" <= d AND d < m."end"))
    SELECT account_id, min(d) AS "start", max(d) + 1 AS "end" FROM bare GROUP BY account_id, run""")
def coverage_holes(L: Ledger):
    date = lambda d: F.lit(d).cast("date")
    return intervals.holes(intervals.merge(L.coverage), L.accounts, date(FROM), date(TO))


@query("coverage", f"""WITH {MERGED} SELECT account_id, prev AS "start", "start" AS "end" FROM (SELECT *, lag("end") OVER (PARTITION BY account_id ORDER BY "start") AS prev FROM m) WHERE prev < "start" """)
def coverage_inner_holes(L: Ledger):
    return intervals.inner_holes(intervals.merge(L.coverage))


BANDS = """
    d AS (SELECT DISTINCT account_id, provider_ref, TRY_CAST(booking_date AS DATE) AS d FROM transactions WHERE provider_ref IS NOT NULL AND booking_date ~ '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'),
    b AS (SELECT account_id, provider_ref, min(d) AS anchor FROM d GROUP BY ALL
          UNION ALL
          SELECT b.account_id, b.provider_ref, (SELECT min(d.d) FROM d WHERE d.account_id = b.account_id AND d.provider_ref = b.provider_ref AND d.d > b.anchor + 3) FROM b
          WHERE EXISTS (SELECT 1 FROM d WHERE d.account_id = b.account_id AND d.provider_ref = b.provider_ref AND d.d > b.anchor + 3))"""


@query("transactions", f"""WITH RECURSIVE {BANDS} SELECT account_id, provider_ref, anchor FROM b""")
def restatement_bands(L: Ledger):
    rows = L.transactions.filter("provider_ref IS NOT NULL").withColumn("d", text.strict_date(F.col("booking_date"))).filter("d IS NOT NULL")
    return intervals.bands(rows, ["account_id", "provider_ref"], "d").select("account_id", "provider_ref", "anchor")


@query("transactions", f"""
    WITH RECURSIVE {BANDS}
    SELECT b.account_id, b.provider_ref, b.anchor, arg_min(t.row_id, (CASE t.status WHEN 'BOOK' THEN 0 ELSE 2 END, t.booking_date, t.row_id)) AS survivor
    FROM b JOIN transactions t ON t.account_id = b.account_id AND t.provider_ref = b.provider_ref AND TRY_CAST(t.booking_date AS DATE) BETWEEN b.anchor AND b.anchor + 3
    GROUP BY ALL""")
def band_survivor(L: Ledger):
    """Of the restatements of one transaction the booked one stays, else the earliest."""
    rows = L.transactions.filter("provider_ref IS NOT NULL").withColumn("d", text.strict_date(F.col("booking_date"))).filter("d IS NOT NULL")
    found = intervals.bands(rows, ["account_id", "provider_ref"], "d")
    rank = F.when(F.col("status").isin("BOOK", "BOOKED"), 0).when(F.col("status").isin("PDNG", "PNDG", "PENDING", "HOLD"), 2).otherwise(1)
    each = rows.join(found, ["account_id", "provider_ref"]).filter("d BETWEEN anchor AND last")
    return each.groupBy("account_id", "provider_ref", "anchor").agg(F.min_by("row_id", F.struct(rank, "booking_date", "row_id")).alias("survivor"))


TRUST_IDENTITY = ["account_id", "amount_minor", "currency", "direction"]
MEASURED = """
    k AS (SELECT account_id % 50 AS run, provider_ref, provider_ref_kind, account_id, direction, currency, amount_minor // 20000000 AS amount_minor, TRY_CAST(booking_date AS DATE) AS d FROM transactions
          WHERE provider_ref IS NOT NULL AND booking_date ~ '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'),
    b AS (SELECT run, provider_ref, account_id, direction, currency, amount_minor, min(d) AS anchor FROM k GROUP BY ALL
          UNION ALL
          SELECT b.run, b.provider_ref, b.account_id, b.direction, b.currency, b.amount_minor, n.d FROM b, LATERAL (SELECT min(k.d) AS d FROM k WHERE k.run = b.run AND k.provider_ref = b.provider_ref AND k.account_id = b.account_id
              AND k.direction IS NOT DISTINCT FROM b.direction AND k.currency IS NOT DISTINCT FROM b.currency AND k.amount_minor = b.amount_minor AND k.d > b.anchor + 3) n WHERE n.d IS NOT NULL),
    e AS (SELECT b.*, (SELECT max((k.provider_ref_kind = 'entry_reference')::INT) FROM k WHERE k.run = b.run AND k.provider_ref = b.provider_ref AND k.account_id = b.account_id AND k.direction IS NOT DISTINCT FROM b.direction
              AND k.currency IS NOT DISTINCT FROM b.currency AND k.amount_minor = b.amount_minor AND k.d BETWEEN b.anchor AND b.anchor + 3) AS entry FROM b),
    r AS (SELECT run, provider_ref, count(*) AS groups, sum(entry) AS entries, min(anchor) FILTER (entry = 1) AS lo, max(anchor) FILTER (entry = 1) AS hi FROM e GROUP BY ALL),
    measured AS (SELECT run, (SELECT count(*) FROM transactions t WHERE t.account_id % 50 = r.run) AS rows_total, sum(entries)::BIGINT AS ref_transactions, count(*) AS distinct_refs,
           count(*) FILTER (groups > 1) AS reused_refs, coalesce(max(hi) - min(lo), 0)::BIGINT AS span_days FROM r GROUP BY run)"""


def _measured(L: Ledger):
    rows = L.transactions.withColumn("run", F.col("account_id") % 50).withColumn("amount_minor", F.expr("amount_minor div 20000000"))
    return trust.measure_references(rows, ["run"], TRUST_IDENTITY)


@query("transactions", f"WITH RECURSIVE {MEASURED} SELECT * FROM measured")
def measure_references(L: Ledger):
    return _measured(L)


OBSERVED = """o AS (SELECT o_custkey AS account_id, 'BANK' || (o_custkey % 7) AS aspsp, CASE WHEN o_orderkey % 3 = 0 THEN 'deep' ELSE 'routine' END AS kind,
    80 + o_orderkey % 90 AS ref_transactions, CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END AS reused_refs, 150 + o_orderkey % 60 AS span_days FROM orders)"""


def _observations(L: Ledger):
    key, account = F.col("o_orderkey"), F.col("o_custkey")
    return L.table("orders").select(
        account.alias("account_id"), F.concat(F.lit("BANK"), (account % 7).cast("string")).alias("aspsp"), F.when(key % 3 == 0, "deep").otherwise("routine").alias("kind"),
        (80 + key % 90).alias("ref_transactions"), F.when(key % 41 == 0, 1).otherwise(0).alias("reused_refs"), (150 + key % 60).alias("span_days"),
    )


@query("accounts", f"""
    WITH {OBSERVED}, v AS (SELECT account_id, aspsp, bool_or(reused_refs > 0) AS reuse, max(ref_transactions) FILTER (kind = 'deep' AND ref_transactions >= 100 AND span_days >= 180) AS best FROM o GROUP BY ALL)
    SELECT account_id, s AS ref_stable, CASE WHEN s THEN 'account' ELSE 'unknown' END AS ref_scope, CASE WHEN s THEN best ELSE 0 END AS observed_n
    FROM (SELECT a.account_id, v.best, coalesce(NOT v.reuse AND v.best IS NOT NULL, false) AS s FROM accounts a LEFT JOIN v ON v.account_id = a.account_id AND v.aspsp = a.aspsp)""")
def capability(L: Ledger):
    return trust.capability(_observations(L), L.accounts)


@query("accounts", f"""
    WITH {OBSERVED} SELECT a.account_id, CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.account_id = a.account_id) THEN 'unmeasured'
        WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.account_id = a.account_id AND o.aspsp = a.aspsp) THEN 'renamed' END AS warning FROM accounts a""")
def capability_warning(L: Ledger):
    return trust.capability_warning(_observations(L), L.accounts)


RULE_HIT = f"""
    p AS (SELECT *, lower(trim(regexp_replace(coalesce(counterparty, ''), '\\s+', ' ', 'g'))) AS party, regexp_split_to_array(lower(coalesce(remittance, '')), '[^a-z0-9]+') AS toks,
          CASE WHEN booking_date ~ '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN TRY_CAST(booking_date AS DATE) END AS day FROM transactions WHERE {LIVE}),
    hit AS (SELECT p.row_id, r.rule_id, string_split(r.tags, ' ') AS tags FROM p, rules r WHERE (r.counterparty_canon IS NULL OR r.counterparty_canon = p.party)
        AND (r.remittance_token IS NULL OR list_contains(p.toks, r.remittance_token)) AND (r.direction IS NULL OR coalesce(r.direction = p.direction, false))
        AND (r.currency IS NULL OR coalesce(r.currency = upper(trim(p.currency)), false)) AND (r.amount_min_minor IS NULL OR p.amount_minor >= r.amount_min_minor) AND (r.amount_max_minor IS NULL OR p.amount_minor <= r.amount_max_minor)
        AND (r.dom_min IS NULL OR coalesce(day(p.day) >= r.dom_min, false)) AND (r.dom_max IS NULL OR coalesce(day(p.day) <= r.dom_max, false))
        AND (r.weekdays IS NULL OR coalesce(list_contains(string_split(r.weekdays, ','), ['mon','tue','wed','thu','fri','sat','sun'][isodow(p.day)]), false)))"""


@query("transactions rules", f"WITH {RULE_HIT} SELECT row_id, rule_id FROM hit")
def rule_match(L: Ledger):
    return rules.matches(reads.listed(L.transactions), L.rules).select("row_id", "rule_id")


@query("transactions rules tags", f"WITH {RULE_HIT} SELECT DISTINCT row_id, tag FROM (SELECT row_id, unnest(tags) AS tag FROM hit) n WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.row_id = n.row_id AND t.tag = n.tag)")
def apply_rules(L: Ledger):
    return rules.apply_rules(reads.listed(L.transactions), L.tags, L.rules)


@query("transactions rules tags", f"""
    WITH {RULE_HIT} SELECT rule_id, outcome, count(*) AS n FROM (
        SELECT rule_id, CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest(hit.tags) AS g) u WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.row_id = hit.row_id AND t.tag = u.g)) THEN 'changed' ELSE 'already' END AS outcome FROM hit) GROUP BY ALL""")
def rule_report(L: Ledger):
    return rules.judged(reads.listed(L.transactions), L.tags, L.rules).groupBy("rule_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("rules", """
    SELECT rule_id, '[' || concat_ws(',', CASE WHEN counterparty_canon IS NULL THEN 'null' ELSE '"' || counterparty_canon || '"' END, CASE WHEN remittance_token IS NULL THEN 'null' ELSE '"' || remittance_token || '"' END,
        CASE WHEN direction IS NULL THEN 'null' ELSE '"' || direction || '"' END, CASE WHEN currency IS NULL THEN 'null' ELSE '"' || currency || '"' END, coalesce(amount_min_minor::VARCHAR, 'null'), coalesce(amount_max_minor::VARCHAR, 'null'),
        coalesce(dom_min::VARCHAR, 'null'), coalesce(dom_max::VARCHAR, 'null'), CASE WHEN weekdays IS NULL THEN 'null' ELSE '"' || weekdays || '"' END) || ']' AS signature FROM rules""")
def rule_signature(L: Ledger):
    return L.rules.select("rule_id", rules.signature().alias("signature"))


@query("rules", """
    WITH c AS (SELECT c_custkey AS rule_id, 'payee ' || (c_custkey % 1200) || ' gmbh' AS party, min(c_custkey) OVER (PARTITION BY c_custkey % 1200) AS first FROM customer),
    f AS (SELECT rule_id, row_number() OVER (ORDER BY rule_id) AS k FROM c WHERE rule_id = first AND party NOT IN (SELECT counterparty_canon FROM rules WHERE counterparty_canon IS NOT NULL AND concat(remittance_token, direction, currency, amount_min_minor, amount_max_minor, dom_min, dom_max, weekdays) = ''))
    SELECT rule_id, CASE WHEN k IS NULL THEN 'duplicate' WHEN k <= 492 THEN 'added' ELSE 'full' END AS outcome FROM c LEFT JOIN f USING (rule_id)""")
def rule_dedupe(L: Ledger):
    """A rule offered for every customer, many alike and one as in the book; the book takes them until it is full."""
    party = F.concat(F.lit("payee "), (F.col("c_custkey") % 1200).cast("string"), F.lit(" gmbh")).alias("counterparty_canon")
    offered = L.table("customer").select(F.col("c_custkey").alias("rule_id"), party, F.lit("offered").alias("tags"))
    blank = [F.lit(None).cast(t.dataType).alias(t.name) for t in L.rules.schema if t.name not in offered.columns]
    return rules.judged_additions(L.rules, offered.select("*", *blank))


@query("rules", "SELECT rule_id, CASE WHEN rule_id % 3 = 0 THEN ['no anchor'] WHEN rule_id % 3 = 1 THEN ['currency', 'day band'] ELSE [] END::VARCHAR[] AS problems FROM rules")
def validate_rules(L: Ledger):
    """The rulebook spoilt in known ways: no anchor, a bad currency and a day band out of order."""
    third = F.col("rule_id") % 3
    blank = lambda c: F.when(third == 0, F.lit(None)).otherwise(F.col(c)).alias(c)
    spoilt = L.rules.select(
        "rule_id", blank("counterparty_canon"), blank("remittance_token"), "direction", F.when(third == 1, "eu").otherwise(F.lit("EUR")).alias("currency"), "amount_min_minor", "amount_max_minor",
        F.when(third == 1, 20).otherwise(F.col("dom_min")).alias("dom_min"), F.when(third == 1, 3).otherwise(F.col("dom_max")).alias("dom_max"), "weekdays", "tags",
    )
    return rules.problems(spoilt).select("rule_id", "problems")


@query("rules", """
    SELECT rule_id, concat_ws('; ', 'counterparty is ' || counterparty_canon, 'text has ' || remittance_token, CASE direction WHEN 'DBIT' THEN 'money out' WHEN 'CRDT' THEN 'money in' END,
        CASE WHEN coalesce(amount_min_minor, amount_max_minor) IS NULL THEN 'currency is ' || currency ELSE 'amount ' || coalesce(amount_min_minor::VARCHAR, 'any') || ' to ' || coalesce(amount_max_minor::VARCHAR, 'any') || ' minor ' || currency END,
        CASE WHEN coalesce(dom_min, dom_max) IS NOT NULL THEN 'day ' || coalesce(dom_min::VARCHAR, 'any') || ' to ' || coalesce(dom_max::VARCHAR, 'any') END, 'on ' || weekdays) || ' -> ' || tags AS sentence FROM rules""")
def list_rules(L: Ledger):
    return L.rules.select("rule_id", rules.sentence().alias("sentence"))


@query("transactions", "SELECT DISTINCT lower(trim(regexp_replace(counterparty, '\\s+', ' ', 'g'))) AS canon FROM transactions WHERE counterparty IS NOT NULL")
def rule_canon(L: Ledger):
    return L.transactions.filter("counterparty IS NOT NULL").select("counterparty").distinct().select(text.rule_canon("counterparty").alias("canon")).distinct()


@query("transactions", "SELECT row_id, list_filter(regexp_split_to_array(lower(remittance), '[^a-z0-9]+'), lambda x: x <> '') AS tokens FROM transactions WHERE remittance IS NOT NULL")
def rule_tokens(L: Ledger):
    return L.transactions.filter("remittance IS NOT NULL").select("row_id", text.tokens(text.canon_ascii(F.col("remittance"))).alias("tokens"))


@query("transactions", """
    SELECT count(DISTINCT (account_id, amount_minor, coalesce(lower(trim(currency)), '-'), coalesce(lower(direction), '-'), coalesce(lower(trim(regexp_replace(counterparty, '\\s+', ' ', 'g'))), '-'), coalesce(lower(remittance), '-'))) AS identities, count(*) AS n FROM transactions""")
def identity_key(L: Ledger):
    from tallywright.operators.identity import identity

    return L.transactions.select(identity().alias("k")).agg(F.countDistinct("k").alias("identities"), F.count(F.lit(1)).alias("n"))


@query("", "SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN ['rent', 'tag-' || (o_orderkey % 3)] ELSE ['rent'] END AS tags FROM orders")
def tag_normalise(L: Ledger):
    key = F.col("o_orderkey")
    raw = F.when(key % 7 == 0, F.array(F.lit("Rent"), F.lit("-bad"))).when(key % 2 == 0, F.array(F.lit(" Rent "), F.concat(F.lit("TAG-"), (key % 3).cast("string")), F.lit("rent"))).otherwise(F.array(F.lit("RENT")))
    return L.table("orders").select(key.alias("row_id"), rules.normal_tags(raw).alias("tags"))


CALLS = """
    c AS (SELECT row_id // 100 AS call, row_id, state NOT IN ('active', 'vanished') AS dead FROM transactions WHERE state IN ('active', 'vanished') OR row_id // 100 % 5 = 0)"""


def _calls(L: Ledger, tag: str):
    """All rows in calls of a hundred ids; every fifth call names superseded rows too, for which it is refused."""
    call = F.expr("row_id div 100")
    return L.transactions.filter(F.col("state").isin(*reads.LISTED) | (call % 5 == 0)).select(call.alias("call"), "row_id", F.lit(tag).alias("tag"))


@query("transactions tags", f"""
    WITH {CALLS}, held AS (SELECT row_id, tag FROM tags UNION ALL SELECT row_id, 'x' || k FROM transactions, range(32) r(k) WHERE row_id % 997 = 0),
    bad AS (SELECT call FROM c WHERE dead OR row_id IN (SELECT row_id FROM held GROUP BY 1 HAVING count(*) >= 32))
    SELECT row_id, tag FROM held UNION ALL SELECT row_id, 'reviewed' FROM c WHERE call NOT IN (FROM bad)""")
def tag_batch(L: Ledger):
    """Every row is asked to be tagged; some rows have 32 tags, and a call that names one changes nothing."""
    crowded = L.transactions.filter("row_id % 997 = 0").select("row_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.concat(F.lit("x"), k.cast("string")))).alias("tag"))
    return annotate.tag_rows(_calls(L, "reviewed"), L.transactions, L.tags.unionByName(crowded))


@query("transactions tags", f"""WITH {CALLS} SELECT row_id, tag FROM tags WHERE tag <> 'groceries' OR row_id NOT IN (SELECT row_id FROM c WHERE call NOT IN (SELECT call FROM c WHERE dead))""")
def untag_batch(L: Ledger):
    return annotate.untag_rows(_calls(L, "groceries"), L.transactions, L.tags)


@query("tags", "SELECT DISTINCT row_id, CASE tag WHEN 'household' THEN 'groceries' ELSE tag END AS tag FROM tags")
def rename_tag(L: Ledger):
    return rules.rename(L.tags, "household", "groceries")


@query("rules", "SELECT rule_id, CASE rule_id WHEN 1 THEN 'food' ELSE tags END AS tags FROM rules WHERE rule_id <> 99")
def delete_tag(L: Ledger):
    return rules.drop_tag(L.rules, "groceries").select("rule_id", "tags")


@query("transactions tags", "SELECT CASE WHEN state IN ('active', 'vanished', 'superseded') THEN state ELSE 'other' END AS state, count(*) AS n FROM tags LEFT JOIN transactions USING (row_id) WHERE tag = 'groceries' GROUP BY 1")
def delete_tag_report(L: Ledger):
    state = F.when(F.col("state").isin("active", "vanished", "superseded"), F.col("state")).otherwise("other").alias("state")
    return L.tags.filter("tag = 'groceries'").join(L.transactions.select("row_id", "state"), "row_id", "left").groupBy(state).agg(F.count(F.lit(1)).alias("n"))


@query("transactions tags", "SELECT DISTINCT coalesce(s.row_id + 1, t.row_id) AS row_id, tag FROM tags t LEFT JOIN (SELECT row_id FROM transactions WHERE state = 'superseded') s USING (row_id)")
def annotation_migration(L: Ledger):
    """Tags of superseded rows move to the row that replaces them (here the next one), once each."""
    return annotate.migrate(L.tags, L.notes, _moved(L))[0]


@query("transactions notes", "SELECT note_id, coalesce(s.row_id + 1, n.row_id) AS row_id FROM notes n LEFT JOIN (SELECT row_id FROM transactions WHERE state = 'superseded') s USING (row_id)")
def note_migration(L: Ledger):
    return annotate.migrate(L.tags, L.notes, _moved(L))[1].select("note_id", "row_id")


def _moved(L: Ledger):
    return L.transactions.filter("state = 'superseded'").select("row_id", (F.col("row_id") + 1).alias("new_id"))


@query("accounts", "SELECT account_id, CASE WHEN account_id % 4 = 0 THEN 'Label ' || account_id ELSE name END AS name, CASE WHEN account_id % 6 = 0 THEN false ELSE included END AS included FROM accounts")
def account_overlay(L: Ledger):
    key = F.col("account_id")
    patch = L.accounts.filter((key % 4 == 0) | (key % 6 == 0)).select("account_id", F.when(key % 4 == 0, F.concat(F.lit("Label "), key.cast("string"))).alias("label"), F.when(key % 6 == 0, False).alias("keep"))
    return L.accounts.join(patch, "account_id", "left").select("account_id", F.coalesce("label", "name").alias("name"), F.coalesce("keep", "included").alias("included"))


@query("accounts", "SELECT account_id, CASE WHEN account_id % 3 = 0 AND account_id % 11 <> 0 THEN 'New ' || account_id ELSE name END AS name, CASE WHEN account_id % 11 = 0 THEN session_id ELSE 's-new' END AS session_id, account_id % 11 = 0 AS refused FROM accounts")
def upsert_accounts(L: Ledger):
    """A fetched account overwrites its session; an absent name keeps the old one; a changed binding is refused."""
    key = F.col("account_id")
    fetched = L.accounts.select("account_id", F.when(key % 3 == 0, F.concat(F.lit("New "), key.cast("string"))).alias("name"), F.lit("s-new").alias("session_id"), F.when(key % 11 == 0, "other").otherwise(F.col("aspsp")).alias("aspsp"))
    return accounts.upsert(L.accounts, fetched).select("account_id", "name", "session_id", "refused")


@query("accounts", "SELECT account_id, a.session_id, CASE WHEN k < 30 THEN 'AUTHORIZED' END AS status FROM accounts a LEFT JOIN (SELECT 's' || k AS session_id, k FROM range(30) r(k)) s USING (session_id)")
def account_sessions(L: Ledger):
    sessions = L.spark.range(30).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("session_id"), F.lit("AUTHORIZED").alias("status"))
    return accounts.with_session(L.accounts, sessions).select("account_id", "session_id", "status")


@query("accounts", "SELECT 2 * account_id AS account_id, 'rebind ' || account_id AS last_error, (SELECT name FROM accounts b WHERE b.account_id = 2 * a.account_id) AS name FROM accounts a WHERE account_id % 4 = 1")
def binding_reviews(L: Ledger):
    """Half of the reviews name accounts that are not there any more."""
    key = F.col("account_id")
    kind = F.when(key % 2 == 1, "account_binding").otherwise("transactions").alias("resource")
    state = F.when(key % 4 < 2, "review_required").otherwise("complete").alias("completeness")
    reviews = L.accounts.select((2 * key).alias("account_id"), kind, state, F.concat(F.lit("rebind "), key.cast("string")).alias("last_error"))
    return accounts.binding_reviews(reviews, L.accounts)


@query("transactions", "SELECT row_id, account_id FROM transactions WHERE account_id % 6 = row_id % 6")
def guarded_write(L: Ledger):
    """Rows were fetched under one of six incarnations; only the account's present one may write."""
    key = F.col("account_id")
    life = L.accounts.select("account_id", (key % 6).cast("string").alias("incarnation"))
    return accounts.guarded(L.transactions.select("row_id", "account_id", (F.col("row_id") % 6).cast("string").alias("incarnation")), life).select("row_id", "account_id")


@query("transactions rules tags", f"""
    WITH {RULE_HIT} SELECT DISTINCT row_id, tag FROM (SELECT row_id, unnest(tags) AS tag FROM hit WHERE row_id IN (SELECT row_id FROM transactions WHERE booking_date >= '1996-01-01' AND booking_date < '1997-01-01')) n
    WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.row_id = n.row_id AND t.tag = n.tag)""")
def apply_rules_scoped(L: Ledger):
    return rules.apply_rules(annotate.scope(L.transactions, start="1996-01-01", end="1997-01-01"), L.tags, L.rules)


@query("transactions notes", """
    SELECT row_id, note_id, author, length(note) AS chars FROM notes UNION ALL
    SELECT row_id, (SELECT max(note_id) FROM notes) + row_number() OVER (ORDER BY row_id), 'operator', 7 FROM (SELECT row_id FROM transactions WHERE state IN ('active', 'vanished') ORDER BY booking_date DESC, row_id DESC LIMIT 100)""")
def add_note(L: Ledger):
    """A note on the hundred newest rows, as many as a call may reach."""
    newest = annotate.scope(L.transactions).orderBy(F.desc("booking_date"), F.desc("row_id")).limit(annotate.ROWS_PER_CALL)
    last = L.notes.agg(F.max("note_id")).first()[0]
    return annotate.add_note(L.notes, newest, "checked", "operator", last).select("row_id", "note_id", "author", F.char_length("note").cast("long").alias("chars"))


@query("transactions", """
    SELECT row_id, CASE review_reason WHEN 'amount_changed' THEN 'the amount changed after booking' WHEN 'direction_or_currency_changed' THEN 'the direction or currency changed after booking'
        WHEN 'provider_ref_reuse' THEN 'provider reference reuse' WHEN 'cluster_oversized' THEN 'cluster oversized' WHEN 'content_present' THEN 'content present' ELSE 'no reason recorded' END AS label FROM transactions""")
def reason_labels(L: Ledger):
    return L.transactions.select("row_id", text.reason_label(F.col("review_reason"), "<fence>", "</fence>").alias("label"))


@query("", """
    SELECT c_custkey AS account_id, seq, kind AS balance_type, CASE WHEN c_custkey % 17 <> 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) END AS amount_minor, 'EUR' AS currency
    FROM customer, (VALUES (0, 'CLBD'), (1, 'XPCD')) v(seq, kind) WHERE c_custkey % 19 <> 0""")
def balances_scan(L: Ledger):
    """Balance answers as the provider sends them; some amounts have too many places, some answers are empty."""
    key, amount = F.col("c_custkey"), F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    one = lambda kind: F.struct(F.lit(kind).alias("balance_type"), F.struct(F.lit("EUR").alias("currency"), F.when(key % 17 == 0, F.concat(amount, F.lit("1"))).otherwise(amount).alias("amount")).alias("balance_amount"), F.lit(None).cast("string").alias("reference_date"))
    answers = L.table("customer").select(key.alias("account_id"), F.to_json(F.struct(F.when(key % 19 == 0, F.slice(F.array(one("CLBD")), 1, 0)).otherwise(F.array(one("CLBD"), one("XPCD"))).alias("balances"))).alias("answer"))
    return feed.balances_of(answers).select("account_id", "seq", "balance_type", "amount_minor", "currency")


@query("transactions", f"""
    WITH n AS (SELECT account_id, substr(max(booking_date), 1, 10) AS d FROM transactions WHERE state = 'active' GROUP BY 1),
    v AS (SELECT account_id, CASE WHEN d ~ '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN DATE '{AS_OF}' - TRY_CAST(d AS DATE) END AS days FROM n)
    SELECT account_id, CASE WHEN days >= 0 THEN days + 7 ELSE 90 END AS days FROM v""")
def refresh_window(L: Ledger):
    newest = L.transactions.filter("state = 'active'").groupBy("account_id").agg(F.max("booking_date").alias("newest"))
    return newest.select("account_id", refresh.window_days(F.col("newest"), F.lit(AS_OF).cast("date")).cast("long").alias("days"))


@query("", "SELECT event_id, CASE WHEN s > 0 THEN least(s, 86400) ELSE 900 END::DOUBLE AS wait FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 0 ELSE (event_id * 37) % 200000 END AS s FROM events)")
def retry_clamp(L: Ledger):
    key = F.col("event_id")
    seconds = F.when(key % 5 == 0, F.lit(None)).when(key % 7 == 0, 0).otherwise(key * 37 % 200000).cast("double")
    return L.table("events").select("event_id", refresh.retry_after(seconds).alias("wait"))


@query("sync_state", f"""
    SELECT account_id, CASE WHEN since < 0 THEN 'future' WHEN since < 900 THEN 'cooldown' ELSE 'admitted' END AS admission, coalesce(since < 300, false) AS in_flight
    FROM (SELECT account_id, epoch(TIMESTAMP '{AS_OF} 00:00:00') - epoch(strptime(replace(last_success_at, 'Z', ''), '%Y-%m-%dT%H:%M:%S')) AS since FROM sync_state)""")
def cooldown(L: Ledger):
    now, at = F.lit(f"{AS_OF} 00:00:00").cast("timestamp"), text.instant(F.col("last_success_at"))
    return L.sync_state.select("account_id", refresh.admission(now, at, F.lit(None).cast("timestamp"), F.lit(True)).alias("admission"), refresh.in_flight(now, at).alias("in_flight"))


@query("sync_state", "SELECT account_id, CASE WHEN account_id % 2 = 0 AND account_id % 3 <> 0 THEN completeness WHEN account_id % 3 = 0 THEN 'partial' ELSE 'complete' END AS completeness FROM sync_state")
def completeness_restore(L: Ledger):
    key = F.col("account_id")
    current = F.when(key % 3 == 0, "partial").otherwise("complete")
    return L.sync_state.select("account_id", refresh.completeness(F.col("completeness"), current, key % 2 == 0).alias("completeness"))


@query("balances", "SELECT account_id, balance_type, amount_minor FROM balances WHERE account_id % 5 <> 0 UNION ALL SELECT DISTINCT account_id, 'CLBD', 1::BIGINT FROM balances WHERE account_id % 5 = 0")
def balance_set(L: Ledger):
    """Every fifth account answers with one balance, the others with none."""
    held = L.balances.select("account_id", "balance_type", "amount_minor")
    fetched = held.filter("account_id % 5 = 0").select("account_id", F.lit("CLBD").alias("balance_type"), F.lit(1).cast("long").alias("amount_minor")).distinct()
    return refresh.replace_set(held, fetched, ["account_id", "balance_type"], "account_id")


@query("accounts sync_state", "SELECT account_id FROM accounts JOIN sync_state USING (account_id) WHERE completeness = 'complete' AND last_success_session = session_id")
def deep_fetch_complete(L: Ledger):
    return L.accounts.join(L.sync_state, "account_id").filter("completeness = 'complete' AND last_success_session = session_id").select("account_id")


@query("transactions", "SELECT account_id, greatest('1997-06-01', min(booking_date)) AS bound FROM transactions GROUP BY 1")
def proven_bound(L: Ledger):
    first = L.transactions.groupBy("account_id").agg(F.min("booking_date").alias("first"))
    return first.select("account_id", F.when(F.col("first").isNotNull(), F.greatest(F.lit("1997-06-01"), "first")).alias("bound"))


@query("accounts", """
    SELECT aspsp, session_id, generation FROM (SELECT aspsp, session_id, account_id % 4 AS generation, row_number() OVER (PARTITION BY aspsp ORDER BY account_id % 4 DESC, account_id % 9 DESC, session_id DESC) AS k FROM accounts WHERE included) WHERE k = 1""")
def renewable_session(L: Ledger):
    key = F.col("account_id")
    return accounts.renewable(L.accounts.filter("included").select("aspsp", "session_id", (key % 4).alias("generation"), (key % 9).alias("authorized_at")))


@query("accounts", """
    SELECT aspsp, CASE WHEN n = 0 THEN 'zero' WHEN miss > 0 THEN 'missing' WHEN extra > 0 THEN 'unexpected' WHEN more > 0 THEN 'currency' ELSE 'exact' END AS verdict, miss AS missing, extra AS unexpected, more AS extra_currency FROM (
        SELECT 'B' || (account_id % 60) AS aspsp, count(*) FILTER (account_id % 81 <> 0) AS n, count(*) FILTER (account_id % 81 = 0 AND included) AS miss, count(*) FILTER (account_id % 81 <> 0 AND NOT included) AS extra,
               count(*) FILTER (account_id % 81 <> 0 AND account_id % 7 = 3) AS more FROM accounts GROUP BY 1)""")
def verify_accounts(L: Ledger):
    """What banks returned against what was intended; some accounts come back in two currencies."""
    key = F.col("account_id")
    each = L.accounts.select(F.concat(F.lit("B"), (key % 60).cast("string")).alias("aspsp"), key.alias("number"), "currency", "included")
    got = each.filter("number % 81 <> 0")
    return accounts.verify(each.filter("included"), got.unionByName(got.filter("number % 7 = 3").withColumn("currency", F.lit("CHF"))))


@query("", "SELECT user_id AS account_id, count(*) AS pages, count(*) <= 60 AND bool_or(event_id % 3 = 0) AS complete FROM events GROUP BY 1")
def page_completeness(L: Ledger):
    """A paged fetch counts only if it ended (a page without a continuation) within the page cap."""
    pages = L.table("events").select(F.col("user_id").alias("account_id"), F.when(F.col("event_id") % 3 != 0, "next").alias("continuation_key"))
    whole = feed.complete(pages).select("account_id").distinct().withColumn("complete", F.lit(True))
    return pages.groupBy("account_id").agg(F.count(F.lit(1)).alias("pages")).join(whole, "account_id", "left").select("account_id", "pages", F.coalesce("complete", F.lit(False)).alias("complete"))


@query("coverage", """SELECT count(*) FILTER ("end" <= DATE '2024-01-16') AS dropped, count(*) FILTER ("start" < DATE '2024-01-16' AND "end" > DATE '2024-01-16') AS trimmed FROM coverage""")
def purge_coverage(L: Ledger):
    return erase.purged_coverage(L.coverage, "2024-01-16")


@query("transactions tags notes coverage", """
    WITH gone AS (SELECT row_id FROM transactions WHERE booking_date < '1998-01-01')
    SELECT 'transactions' AS name, (SELECT count(*) FROM transactions) AS before, (SELECT count(*) FROM transactions WHERE booking_date >= '1998-01-01') AS after
    UNION ALL SELECT 'tags', (SELECT count(*) FROM tags), (SELECT count(*) FROM tags WHERE row_id NOT IN (FROM gone))
    UNION ALL SELECT 'notes', (SELECT count(*) FROM notes), (SELECT count(*) FROM notes WHERE row_id NOT IN (FROM gone))
    UNION ALL SELECT 'refs', (SELECT count(provider_ref) FROM transactions), (SELECT count(provider_ref) FROM transactions WHERE row_id NOT IN (FROM gone))
    UNION ALL SELECT 'coverage', (SELECT count(*) FROM coverage), (SELECT count(*) FROM coverage WHERE "end" > DATE '1998-01-01')""")
def purge(L: Ledger):
    tables = {"transactions": L.transactions, "tags": L.tags, "notes": L.notes, "refs": _refs(L), "coverage": L.coverage}
    return erase.counts(tables, erase.purge(tables, "1998-01-01"))


@query("transactions tags notes coverage balances accounts sync_state", """
    WITH gone AS (SELECT row_id FROM transactions WHERE account_id = 7)
    SELECT 'transactions' AS name, (SELECT count(*) FROM transactions) AS before, (SELECT count(*) FROM transactions WHERE account_id <> 7) AS after
    UNION ALL SELECT 'tags', (SELECT count(*) FROM tags), (SELECT count(*) FROM tags WHERE row_id NOT IN (FROM gone))
    UNION ALL SELECT 'notes', (SELECT count(*) FROM notes), (SELECT count(*) FROM notes WHERE row_id NOT IN (FROM gone))
    UNION ALL SELECT 'refs', (SELECT count(provider_ref) FROM transactions), (SELECT count(provider_ref) FROM transactions WHERE row_id NOT IN (FROM gone))
    UNION ALL SELECT 'coverage', (SELECT count(*) FROM coverage), (SELECT count(*) FROM coverage WHERE account_id <> 7)
    UNION ALL SELECT 'balances', (SELECT count(*) FROM balances), (SELECT count(*) FROM balances WHERE account_id <> 7)
    UNION ALL SELECT 'accounts', (SELECT count(*) FROM accounts), (SELECT count(*) FROM accounts WHERE account_id <> 7)
    UNION ALL SELECT 'sync_state', (SELECT count(*) FROM sync_state), (SELECT count(*) FROM sync_state WHERE account_id <> 7)
    UNION ALL SELECT 'observations', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_custkey <> 7)""")
def forget(L: Ledger):
    tables = {"transactions": L.transactions, "tags": L.tags, "notes": L.notes, "refs": _refs(L), "coverage": L.coverage, "balances": L.balances, "accounts": L.accounts, "sync_state": L.sync_state, "observations": _observations(L)}
    return erase.counts(tables, erase.forget(tables, 7))


def _refs(L: Ledger):
    return L.transactions.filter("provider_ref IS NOT NULL").select("row_id", F.col("provider_ref").alias("ref"))
