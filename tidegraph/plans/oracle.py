"""The registered queries in plain SQL, as DuckDB runs it on the same tables."""

from __future__ import annotations

EDGES = """
edges AS (
  SELECT 'region' AS from_type, CAST(n_regionkey AS VARCHAR) AS from_id,
         'nation' AS to_type, CAST(min(n_nationkey) AS VARCHAR) AS to_id FROM nation GROUP BY n_regionkey
  UNION SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'region', CAST(n_regionkey AS VARCHAR) FROM nation
  UNION SELECT 'customer', CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_acctbal >= 0
  UNION SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_acctbal >= 0
  UNION SELECT 'part', CAST(p_partkey AS VARCHAR), 'warehouse', CAST(p_size AS VARCHAR) FROM part
  UNION SELECT 'order', CAST(o_orderkey AS VARCHAR), 'customer', CAST(o_custkey AS VARCHAR) FROM orders
  UNION SELECT 'order', CAST(l_orderkey AS VARCHAR), 'part', CAST(l_partkey AS VARCHAR) FROM lineitem
  UNION SELECT 'order', CAST(l_orderkey AS VARCHAR), 'supplier', CAST(l_suppkey AS VARCHAR) FROM lineitem
)"""

LIVE = """
live AS (
  SELECT 'region' AS type, CAST(r_regionkey AS VARCHAR) AS id, r_name AS label FROM region
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE NOT c_acctbal < 0
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE NOT s_acctbal < 0
  UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part
  UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders
)"""

UPDATES = """
updates AS (
  SELECT 'order' AS type, CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS event_time FROM orders
  UNION ALL SELECT 'customer', CAST(o_custkey AS VARCHAR), o_orderdate FROM orders
  UNION ALL SELECT 'part', CAST(l_partkey AS VARCHAR), l_shipdate FROM lineitem
  UNION ALL SELECT 'supplier', CAST(l_suppkey AS VARCHAR), l_shipdate FROM lineitem
)"""

HISTORY = (
    UPDATES
    + """,
history AS (
  SELECT type, id, event_time, row_number() OVER (ORDER BY event_time, type, id) AS seq
  FROM (SELECT type, id, max(event_time) AS event_time FROM updates GROUP BY type, id)
)"""
)

FEEDS = """
balances AS (
  SELECT *, CAST(floor(greatest(c_acctbal, 0.0)) AS BIGINT) AS balance FROM customer
),
nation_acks AS (
  SELECT n_nationkey, n_regionkey, (SELECT max(balance) FROM balances WHERE c_nationkey = n_nationkey) AS ack FROM nation
),
feeds AS (
  SELECT 'region-' || n_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id,
         CAST(NULL AS VARCHAR[]) AS type_filter, coalesce(min(ack), 0) AS max_ack
  FROM nation_acks GROUP BY n_regionkey
  UNION ALL
  SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey, ['order', 'supplier'], coalesce(ack, 0) FROM nation_acks
  UNION ALL
  SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['order'] WHEN 'BUILDING' THEN ['customer', 'order']
              WHEN 'FURNITURE' THEN CAST([] AS VARCHAR[]) WHEN 'MACHINERY' THEN ['part', 'region'] END,
         balance
  FROM balances
),
registry AS (
  SELECT f.*, coalesce(p.max_ack, (SELECT max(seq) FROM history), 0) AS parent_max_ack,
         (SELECT arg_max(event_time, seq) FROM history h WHERE list_contains(f.type_filter, h.type)) AS max_event_time
  FROM feeds f LEFT JOIN feeds p ON p.id = f.parent_id
)"""

POLL = """
cursors AS (
  SELECT id, type_filter, max_ack, max_ack AS from_ack, greatest(parent_max_ack, max_ack) AS parent_max_ack FROM registry
),
delivered AS (
  SELECT c.id AS feed, h.type, h.id, h.seq
  FROM cursors c JOIN history h ON h.seq > c.from_ack AND h.seq <= c.parent_max_ack
  WHERE c.type_filter IS NULL OR list_contains(c.type_filter, h.type)
  QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY h.seq) <= 10
),
advanced AS (
  SELECT c.id, c.max_ack, c.parent_max_ack,
         CASE WHEN c.from_ack >= c.parent_max_ack THEN c.from_ack
              WHEN coalesce(d.n, 0) < 10 THEN c.parent_max_ack ELSE d.last END AS from_ack,
         coalesce(d.n, 0) AS inflight, d.seqs
  FROM cursors c LEFT JOIN (SELECT feed, count(*) AS n, max(seq) AS last, list(seq) AS seqs FROM delivered GROUP BY feed) d ON d.feed = c.id
)"""


def _writes(seq: str = "CAST(props->>'k' AS BIGINT)", stored: bool = False) -> str:
    """Running state of the users; `c` stands for the body of a write, which includes its sequence."""
    prior = """
  UNION ALL
  SELECT -1, CAST(c_custkey AS VARCHAR), TIMESTAMP '2023-12-31', false, CAST(c_nationkey AS BIGINT), 'stored', 'stored'
  FROM customer WHERE c_custkey IN (SELECT user_id FROM events)"""
    return f"""
w AS (
  SELECT event_id AS ord, CAST(user_id AS VARCHAR) AS id, ts, event_type = 'signup' AS deleted, {seq} AS seq,
         CASE WHEN event_type = 'signup' THEN '' ELSE event_type || '|' || value || '|' || (props->>'k') END AS core,
         CASE WHEN event_type = 'signup' THEN '' ELSE event_type || '|' || value || '|' || (props->>'k') END AS c
  FROM events{prior if stored else ""}
),
m AS (
  SELECT *, max(seq) OVER past AS pm, count(*) OVER past AS n FROM w
  WINDOW past AS (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
a AS (SELECT *, pm IS NULL OR coalesce(seq > pm, false) AS adv FROM m),
p AS (
  SELECT *,
    last_value(CASE WHEN adv THEN {{'seq': seq, 'deleted': deleted, 'c': c, 'core': core}} END IGNORE NULLS) OVER
      (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM a
),
classified AS (
  SELECT *,
    CASE WHEN ord = -1 THEN NULL
         WHEN n = 0 THEN 'Created'
         WHEN NOT adv AND NOT coalesce(seq = pm AND deleted = prev.deleted AND c = prev.c, false) THEN 'OutOfSequence'
         WHEN seq IS NOT DISTINCT FROM prev.seq AND deleted = prev.deleted AND c = prev.c THEN 'NotModified'
         ELSE 'Updated' END AS result,
    ord >= 0 AND (n = 0 OR (adv AND (deleted <> prev.deleted OR core <> prev.core))) AS changed
  FROM p
)"""


RESULTS = "SELECT 'user' AS type, id, ord, result FROM classified WHERE ord >= 0"

CLOSURE = """
reached AS (
  SELECT type, id FROM seeds
  UNION
  SELECT e.from_type, e.from_id FROM edges e JOIN reached r ON e.to_type = r.type AND e.to_id = r.id
)
SELECT type, id FROM reached"""

LIVE_LINKS = """
links AS (SELECT e.* FROM edges e SEMI JOIN live l ON e.to_type = l.type AND e.to_id = l.id)"""

# Needs `roots(type, id)`.
PAIRS = """
pairs AS (
  SELECT r.type AS root_type, r.id AS root_id, e.to_type AS type, e.to_id AS id
  FROM roots r JOIN links e ON e.from_type = r.type AND e.from_id = r.id
  UNION
  SELECT p.root_type, p.root_id, e.to_type, e.to_id
  FROM pairs p JOIN links e ON e.from_type = p.type AND e.from_id = p.id
),
hydrated AS (
  SELECT type AS root_type, id AS root_id, 'data' AS role, type, id FROM roots
  UNION ALL SELECT root_type, root_id, 'included', type, id FROM pairs
)"""

SHARED = """
reached AS (
  SELECT e.to_type AS type, e.to_id AS id FROM roots r JOIN links e ON e.from_type = r.type AND e.from_id = r.id
  UNION
  SELECT e.to_type, e.to_id FROM reached r JOIN links e ON e.from_type = r.type AND e.from_id = r.id
)
SELECT 'data' AS role, l.type, l.id, l.label FROM roots r JOIN live l ON l.type = r.type AND l.id = r.id
UNION ALL
SELECT 'included', l.type, l.id, l.label FROM reached r JOIN live l ON l.type = r.type AND l.id = r.id"""

CHANGES = """
changes AS (
  SELECT event_id AS key, CASE WHEN event_type = 'purchase' THEN 'customer' ELSE 'part' END AS type,
         CASE WHEN event_type = 'purchase' THEN CAST(user_id AS VARCHAR) ELSE props->>'k' END AS id
  FROM events
),
spread AS (
  SELECT type, id, max(key) AS key FROM changes GROUP BY type, id
  UNION
  SELECT e.from_type, e.from_id, s.key FROM edges e JOIN spread s ON e.to_type = s.type AND e.to_id = s.id
),
last_key AS (SELECT type, id, max(key) AS key FROM spread GROUP BY type, id)"""

ACKS = """
acks AS (
  SELECT event_id AS ord, 'customer-' || user_id AS id, CAST(props->>'k' AS BIGINT) * 100 AS ack, ts FROM events
),
checked AS (
  SELECT a.*, CASE WHEN r.id IS NULL THEN 'unknown' WHEN a.ack > r.parent_max_ack THEN 'beyond_parent' ELSE 'accepted' END AS outcome
  FROM acks a LEFT JOIN registry r ON r.id = a.id
),
best AS (SELECT id, max(ack) AS ack, arg_max(ts, ack * 1000000000 - ord) AS at FROM checked WHERE outcome = 'accepted' GROUP BY id),
after_acks AS (
  SELECT f.id, greatest(f.max_ack, b.ack) AS max_ack, f.max_ack AS old_ack,
         epoch_us(CASE WHEN b.ack > f.max_ack THEN b.at ELSE TIMESTAMP '2024-01-01' END) AS last_ack_us
  FROM feeds f LEFT JOIN best b ON b.id = f.id
)"""

PARENT_ACKS = """
acks AS (
  SELECT event_id AS ord, CASE WHEN event_type = 'purchase' THEN 'region-' || (user_id % 5) ELSE 'nation-' || (user_id % 25) END AS id,
         CAST(props->>'k' AS BIGINT) * 100 AS ack
  FROM events
),
region_acks AS (
  SELECT a.id, a.ord, a.ack FROM acks a JOIN registry r ON r.id = a.id AND a.ack <= r.parent_max_ack WHERE a.id LIKE 'region-%'
),
nation_steps AS (
  SELECT a.id, a.ord, a.ack, max(greatest(coalesce(s.ack, 0), r.parent_max_ack)) AS bound
  FROM acks a JOIN registry r ON r.id = a.id LEFT JOIN region_acks s ON s.id = r.parent_id AND s.ord < a.ord
  WHERE a.id LIKE 'nation-%' GROUP BY a.id, a.ord, a.ack
),
furthest AS (
  SELECT id, max(ack) AS ack FROM (SELECT id, ack FROM region_acks UNION ALL SELECT id, ack FROM nation_steps WHERE ack <= bound) GROUP BY id
),
moved AS (SELECT f.id, a.ack AS bound FROM feeds f JOIN furthest a ON a.id = f.id WHERE a.ack > f.max_ack),
woken AS (
  SELECT f.id, f.parent_id, m.bound
  FROM feeds f JOIN moved m ON m.id = f.parent_id LEFT JOIN furthest a ON a.id = f.id
  WHERE m.bound > greatest(f.max_ack, a.ack)
)"""

CREATES = """
requests AS (
  SELECT s_suppkey AS ord, CASE WHEN s_acctbal < 0 THEN 'nation-' ELSE 'site-' END || s_nationkey AS id,
         'region-' || s_nationkey AS parent_id FROM supplier
),
checked AS (
  SELECT ord, id, parent_id,
         CASE WHEN id IN (SELECT id FROM feeds) OR ord > since THEN 'duplicate' WHEN ord = since THEN 'created'
              ELSE 'unknown_parent' END AS outcome
  FROM (SELECT *, min(ord) FILTER (WHERE parent_id IN (SELECT id FROM feeds)) OVER (PARTITION BY id) AS since FROM requests)
)"""

DELETES = """
requests AS (
  SELECT c_custkey AS ord, 'customer-' || c_custkey AS id FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT c_custkey + 10000000000, 'nation-' || c_nationkey FROM customer
  UNION ALL SELECT s_suppkey + 20000000000, 'supplier-' || s_suppkey FROM supplier
),
-- Children come before their parents in these requests, and two levels are asked for.
kept_parents AS (
  SELECT DISTINCT parent_id FROM feeds WHERE parent_id IS NOT NULL AND id NOT IN (SELECT id FROM requests)
),
checked AS (
  SELECT ord, id, CASE WHEN id NOT IN (SELECT id FROM feeds) THEN 'unknown'
                       WHEN id IN (SELECT parent_id FROM kept_parents) THEN 'has_children'
                       WHEN ord > min(ord) OVER (PARTITION BY id) THEN 'unknown' ELSE 'deleted' END AS outcome
  FROM requests
)"""

WRITE_FAULTS = """
verdicts AS (
  SELECT event_id AS ord, CAST(user_id AS VARCHAR) AS path_id, props->>'k' AS k,
    CASE WHEN event_type = 'view' THEN 'shared_name'
         WHEN event_type = 'signup' THEN 'nested_member'
         WHEN event_type = 'error' THEN 'identifier'
         WHEN event_type = 'click' THEN 'relationship'
         WHEN value >= 20 AND CAST(user_id AS VARCHAR) <> (props->>'k') THEN 'unprocessable' END AS reason
  FROM events
)"""

BATCHES = """
verdicts AS (
  SELECT batch_id, CAST(sum(times) AS BIGINT) AS items,
         CASE WHEN sum(times) > 6 THEN 'too_large' WHEN max(times) > 1 THEN 'unprocessable' ELSE 'ok' END AS verdict
  FROM (SELECT l_orderkey AS batch_id, l_partkey, count(*) AS times FROM lineitem GROUP BY ALL) GROUP BY batch_id
)"""

BURSTS = """
FROM (SELECT event_id, user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM {rows})
WHERE next_ts IS NULL OR epoch_us(next_ts) - epoch_us(ts) > 6 * 3600000000"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts[:-1]) + "\n" + parts[-1]


def _scan(condition: str) -> str:
    return _with(
        HISTORY,
        f"SELECT type, id, seq, epoch_us(event_time) AS event_us FROM history WHERE seq > 1000 AND seq <= (SELECT max(seq) FROM history) AND {condition} ORDER BY seq LIMIT 500",
    )


def _closure_from(seeds: str) -> str:
    return f"WITH RECURSIVE {EDGES}, seeds AS ({seeds}), {CLOSURE}"


def oracle_queries() -> dict[str, str]:
    refs = "'order/' || l_orderkey || ',part/' || l_partkey || ',supplier/' || l_suppkey"
    registry_row = "id, parent_id, max_ack, parent_max_ack, epoch_us(max_event_time) AS max_event_us"
    orders_as_roots = "roots AS (SELECT 'order' AS type, CAST(o_orderkey AS VARCHAR) AS id FROM orders)"
    document = (
        """'{"attributes":{"label":"' || label || '"},"id":"' || id || '","type":"' || type || '"}'"""
    )
    return {
        "relationship_extraction": f"SELECT l_orderkey, l_linenumber, {refs} AS refs FROM lineitem",
        "ingest_writes": """
            SELECT event_id AS ord, 'user' AS type, CAST(user_id AS VARCHAR) AS id, event_type = 'signup' AS deleted,
                   CAST(props->>'k' AS BIGINT) AS seq, props->>'k' AS stored_seq,
                   CASE WHEN event_type <> 'signup' THEN event_type END AS event_type,
                   CASE WHEN event_type = 'signup' THEN '' ELSE 'part/' || (props->>'k') END AS refs
            FROM events""",
        "ingest_batches": """
            SELECT l_orderkey * 10 + l_linenumber AS batch_id, 0 AS pos, 'supplier' AS type, CAST(l_suppkey AS VARCHAR) AS id FROM lineitem
            UNION ALL SELECT l_orderkey * 10 + l_linenumber, 1, 'part', CAST(l_partkey AS VARCHAR) FROM lineitem
            UNION ALL SELECT l_orderkey * 10 + l_linenumber, 2, 'order', CAST(l_orderkey AS VARCHAR) FROM lineitem""",
        "edges": _with(EDGES, "SELECT * FROM edges"),
        "edges_of_resources": """
            SELECT 'user' AS from_type, CAST(c_custkey AS VARCHAR) AS from_id,
                   'nation' AS to_type, CAST(c_nationkey AS VARCHAR) AS to_id FROM customer""",
        "resource_lookup": _with(
            LIVE,
            """SELECT type, id, label FROM live
               WHERE type = 'supplier' AND id IN (SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem)""",
        ),
        "reverse_closure_supplier": _closure_from(
            """SELECT 'nation' AS type, CAST(s_nationkey AS VARCHAR) AS id FROM supplier
               WHERE s_acctbal = (SELECT max(s_acctbal) FROM supplier)"""
        ),
        "reverse_closure_multi": _closure_from(
            "SELECT 'part' AS type, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_type = 'ECONOMY'"
        ),
        "closure_condensed": _closure_from(
            "SELECT 'part' AS type, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_type = 'ECONOMY'"
        ),
        # Only resources that something refers to and that refer to something can be part of a cycle.
        "strong_components": _with(
            EDGES,
            """inner_edges AS (
                 SELECT e.* FROM edges e SEMI JOIN edges f ON e.from_type = f.to_type AND e.from_id = f.to_id
                 SEMI JOIN edges g ON e.to_type = g.from_type AND e.to_id = g.from_id
                 WHERE e.to_type IN ('nation', 'region') AND e.from_type IN ('nation', 'region')
               ),
               ups AS (
                 SELECT from_type AS type, from_id AS id, to_type AS up_type, to_id AS up_id FROM inner_edges
                 UNION
                 SELECT u.type, u.id, e.to_type, e.to_id FROM ups u JOIN inner_edges e ON u.up_type = e.from_type AND u.up_id = e.from_id
               ),
               mates AS (
                 SELECT u.* FROM ups u SEMI JOIN ups v ON v.type = u.up_type AND v.id = u.up_id AND v.up_type = u.type AND v.up_id = u.id
               )""",
            """SELECT type, id, min({'t': up_type, 'i': up_id}).t AS component_type, min({'t': up_type, 'i': up_id}).i AS component_id,
                      count(*) AS members
               FROM mates GROUP BY type, id HAVING count(*) > 1""",
        ),
        "propagate_condensed": _with(EDGES, CHANGES, "SELECT type, id, key FROM last_key"),
        "reverse_closure_dangling": _closure_from(
            "SELECT 'warehouse' AS type, CAST(p_size AS VARCHAR) AS id FROM part"
        ),
        "max_relevant_seqs": _with(
            EDGES,
            HISTORY,
            """ancestry AS (
                 SELECT type, id, type AS up_type, id AS up_id FROM history
                 UNION
                 SELECT e.from_type, e.from_id, a.up_type, a.up_id
                 FROM edges e JOIN ancestry a ON e.to_type = a.type AND e.to_id = a.id
               )""",
            """SELECT a.type, a.id, max(h.seq) AS max_seq
               FROM ancestry a JOIN history h ON h.type = a.up_type AND h.id = a.up_id GROUP BY a.type, a.id""",
        ),
        "hydrate_one": f"""WITH RECURSIVE {EDGES}, {LIVE}, {LIVE_LINKS},
            roots AS (SELECT 'order' AS type, CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1),
            {SHARED}""",
        "hydrate_shared": f"WITH RECURSIVE {EDGES}, {LIVE}, {LIVE_LINKS}, {orders_as_roots}, {SHARED}",
        "hydrate_per_root": _with(
            EDGES, LIVE, LIVE_LINKS, orders_as_roots, PAIRS, "SELECT root_type, root_id, role, type, id FROM hydrated"
        ),
        "hydrate_cycle": _with(
            EDGES,
            LIVE,
            LIVE_LINKS,
            "roots AS (SELECT type, id FROM live WHERE type IN ('supplier', 'nation', 'region'))",
            PAIRS,
            """SELECT root_type, root_id, count(*) FILTER (WHERE role = 'included') AS included,
                      bool_or(role = 'included' AND type = root_type AND id = root_id) AS in_own_document
               FROM hydrated GROUP BY root_type, root_id""",
        ),
        "hydrated_documents": _with(
            EDGES,
            LIVE,
            LIVE_LINKS,
            "roots AS (SELECT type, id FROM live WHERE type = 'supplier')",
            PAIRS,
            f"bodies AS (SELECT type, id, {document} AS body FROM live)",
            """SELECT h.root_type, h.root_id,
                      '{"data":' || max(CASE WHEN role = 'data' THEN body END) || ',"included":[' ||
                      coalesce(string_agg(body, ',' ORDER BY h.type, h.id) FILTER (WHERE role = 'included'), '') || ']}' AS document
               FROM hydrated h JOIN bodies b ON b.type = h.type AND b.id = h.id GROUP BY h.root_type, h.root_id""",
        ),
        "hydrated_list_document": _with(
            EDGES,
            LIVE,
            LIVE_LINKS,
            "roots AS (SELECT type, id FROM live WHERE type = 'nation')",
            SHARED.replace("SELECT 'data' AS role", ", shared AS (SELECT 'data' AS role") + ")",
            f"bodies AS (SELECT type, id, {document} AS body FROM live)",
            """SELECT '{"data":[' || coalesce(string_agg(body, ',' ORDER BY s.type, s.id) FILTER (WHERE role = 'data'), '') ||
                      '],"included":[' || coalesce(string_agg(body, ',' ORDER BY s.type, s.id) FILTER (WHERE role = 'included'), '') ||
                      ']}' AS document
               FROM shared s JOIN bodies b ON b.type = s.type AND b.id = s.id""",
        ),
        "incoming_documents": _with(
            EDGES,
            LIVE,
            """SELECT 'customer' AS to_type, id AS to_id, 'data' AS role, 'customer' AS type, id, label FROM live WHERE type = 'customer'
               UNION ALL
               SELECT e.to_type, e.to_id, 'included', e.from_type, e.from_id, l.label
               FROM edges e JOIN live l ON l.type = e.from_type AND l.id = e.from_id
               JOIN live t ON t.type = e.to_type AND t.id = e.to_id
               WHERE e.from_type = 'order' AND e.to_type = 'customer'""",
        ),
        "incoming_by_type": _with(
            EDGES,
            LIVE,
            """SELECT e.to_type, e.to_id, e.from_type, e.from_id, l.label
               FROM edges e JOIN live l ON l.type = e.from_type AND l.id = e.from_id
               JOIN live t ON t.type = e.to_type AND t.id = e.to_id
               WHERE e.from_type = 'order' AND e.to_type = 'customer'""",
        ),
        "apply_writes_results": _with(_writes(), RESULTS),
        "apply_writes_stored": _with(_writes(stored=True), RESULTS),
        "apply_writes_null_seq": _with(
            _writes("CASE WHEN event_type NOT IN ('view', 'error') THEN CAST(props->>'k' AS BIGINT) END"), RESULTS
        ),
        "apply_writes_state": _with(
            _writes(stored=True),
            """heads AS (
                 SELECT id, max(ord) FILTER (WHERE adv) AS head,
                        CASE WHEN min(ord) = -1 THEN TIMESTAMP '2023-12-31' ELSE arg_min(ts, ord) END AS created,
                        arg_max(ts, ord) FILTER (WHERE result IS NULL OR result IN ('Created', 'Updated')) AS updated
                 FROM classified GROUP BY id
               )""",
            """SELECT 'user' AS type, h.id, c.deleted, c.seq AS sequence_number,
                      CASE WHEN h.head >= 0 AND NOT c.deleted THEN e.event_type END AS event_type,
                      CASE WHEN h.head >= 0 AND NOT c.deleted THEN e.value END AS value,
                      epoch_us(h.created) AS created_us, epoch_us(h.updated) AS updated_us,
                      CASE WHEN h.head = -1 THEN 'nation/' || c.seq WHEN c.deleted THEN '' ELSE 'part/' || c.seq END AS refs
               FROM heads h JOIN classified c ON c.id = h.id AND c.ord = h.head LEFT JOIN events e ON e.event_id = h.head""",
        ),
        "apply_writes_latest": """
            SELECT 'user' AS type, id, last(deleted ORDER BY ord) AS deleted, last(event_type ORDER BY ord) AS event_type,
                   epoch_us(min(ts)) AS created_us, epoch_us(max(ts) FILTER (WHERE moved)) AS updated_us
            FROM (
              SELECT event_id AS ord, CAST(user_id AS VARCHAR) AS id, ts, event_type = 'signup' AS deleted,
                     CASE WHEN event_type <> 'signup' THEN event_type END AS event_type,
                     CASE WHEN event_type = 'signup' THEN '' ELSE event_type || '|' || value || '|' || props END
                       IS DISTINCT FROM lag(CASE WHEN event_type = 'signup' THEN '' ELSE event_type || '|' || value || '|' || props END)
                       OVER (PARTITION BY user_id ORDER BY event_id) AS moved
              FROM events
            ) GROUP BY id""",
        "write_result_tally": _with(
            _writes(),
            """SELECT strftime(ts, '%Y-%m-%d') AS day,
                      count(*) FILTER (WHERE result = 'Created') AS Created, count(*) FILTER (WHERE result = 'Updated') AS Updated,
                      count(*) FILTER (WHERE result = 'NotModified') AS NotModified,
                      count(*) FILTER (WHERE result = 'OutOfSequence') AS OutOfSequence,
                      count(*) FILTER (WHERE result = 'OutOfSequence') > 0 AS conflict
               FROM classified GROUP BY day""",
        ),
        "conflict_report": _with(
            _writes(),
            """SELECT ord // 1000 AS batch_id, '/data(' || (ord % 1000) || ')' AS pointer,
                      '{"type":"user","id":"' || id || '"}' AS detail
               FROM classified WHERE result = 'OutOfSequence'""",
        ),
        "change_capture": _with(
            _writes(stored=True), "SELECT ord AS key, 'user' AS type, id FROM classified WHERE changed"
        ),
        "edge_changes": _with(
            _writes(stored=True),
            """heads AS (
                 SELECT c.id, c.ord, c.deleted, c.seq FROM classified c
                 WHERE adv QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1
               )""",
            """after_refs AS (
                 SELECT 'user' AS from_type, id AS from_id, CASE WHEN ord = -1 THEN 'nation' ELSE 'part' END AS to_type,
                        CAST(seq AS VARCHAR) AS to_id FROM heads WHERE ord = -1 OR NOT deleted
               )""",
            """before_refs AS (
                 SELECT 'user' AS from_type, h.id AS from_id, 'nation' AS to_type, CAST(c_nationkey AS VARCHAR) AS to_id
                 FROM heads h JOIN customer ON CAST(c_custkey AS VARCHAR) = h.id
               )""",
            """SELECT *, 'insert' AS op FROM (SELECT * FROM after_refs EXCEPT SELECT * FROM before_refs)
               UNION ALL SELECT *, 'delete' FROM (SELECT * FROM before_refs EXCEPT SELECT * FROM after_refs)""",
        ),
        "propagate_changes": _with(
            EDGES,
            CHANGES,
            """SELECT type, id, row_number() OVER (ORDER BY key, type, id) AS seq,
                      (SELECT epoch_us(max(ts)) FROM events) AS event_us FROM last_key""",
        ),
        "compact_history": _with(
            EDGES,
            CHANGES,
            HISTORY,
            """merged AS (
                 SELECT type, id, (SELECT max(seq) FROM history) + row_number() OVER (ORDER BY key, type, id) AS seq,
                        (SELECT max(ts) FROM events) AS event_time FROM last_key
                 UNION ALL SELECT type, id, seq, event_time FROM history
               )""",
            """SELECT type, id, max(seq) AS seq, epoch_us(arg_max(event_time, seq)) AS event_us
               FROM merged GROUP BY type, id""",
        ),
        "expanded_per_change": _with(
            EDGES, CHANGES, "SELECT key, count(*) AS expanded FROM last_key GROUP BY key"
        ),
        "latest_log_rows": _with(
            UPDATES,
            """SELECT type, id, max(seq) AS seq, epoch_us(max(event_time)) AS event_us
               FROM (SELECT *, row_number() OVER (ORDER BY event_time, type, id) AS seq FROM updates) GROUP BY type, id""",
        ),
        "high_water_mark": _with(HISTORY, "SELECT coalesce(max(seq), 0) AS max_seq FROM history"),
        "expanded_per_claim": _with(
            EDGES,
            CHANGES,
            """numbered AS (SELECT type, id, (row_number() OVER (ORDER BY key, type, id) - 1) // 1000 AS claim FROM changes),
claimed AS (SELECT claim, count(*) AS claimed FROM (SELECT DISTINCT claim, type, id FROM numbered) GROUP BY claim),
reached_each AS (
  SELECT claim, type, id FROM numbered
  UNION
  SELECT r.claim, e.from_type, e.from_id FROM edges e JOIN reached_each r ON e.to_type = r.type AND e.to_id = r.id
)""",
            "SELECT claim, any_value(claimed) AS claimed, count(*) AS expanded FROM reached_each JOIN claimed USING (claim) GROUP BY claim",
        ),
        "batch_size_extremes": """
SELECT share, quantile_size AS value FROM (
  SELECT 0.0::DOUBLE AS share, min(n) AS quantile_size FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)
  UNION ALL SELECT 1.0::DOUBLE, max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey))""",
        "history_scan_clustered": _with(
            HISTORY,
            """SELECT type, id, seq, epoch_us(event_time) AS event_us FROM history, (SELECT max(seq) AS top FROM history)
WHERE seq > top // 2 AND seq <= top // 2 + top // 100""",
        ),
        "history_scan_all": _scan("true"),
        "history_scan_one_type": _scan("type = 'order'"),
        "history_scan_types": _scan("type IN ('customer', 'part', 'Order')"),
        "history_scan_empty_filter": _scan("false"),
        "feed_registry": _with(HISTORY, FEEDS, f"SELECT {registry_row} FROM registry"),
        "feed_page": _with(HISTORY, FEEDS, f"SELECT {registry_row} FROM registry ORDER BY id LIMIT 25 OFFSET 50"),
        "feed_descriptions": _with(
            HISTORY,
            FEEDS,
            """SELECT id, '{"type":"changefeed","id":"' || id || '","attributes":{"maxAck":' || max_ack ||
                 ',"parentMaxAck":' || parent_max_ack ||
                 coalesce(',"maxEventTime":"' || strftime(max_event_time, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"', '') ||
                 coalesce(',"typeFilter":' || CAST(to_json(type_filter) AS VARCHAR), '') ||
                 ',"created":"2024-01-01T00:00:00.000Z","lastAck":"2024-01-01T00:00:00.000Z"},"relationships":{' ||
                 coalesce('"parent":{"data":{"type":"changefeed","id":"' || parent_id || '"}}', '') || '}}' AS document
               FROM registry""",
        ),
        "feed_create": _with(HISTORY, FEEDS, CREATES, "SELECT ord, id, parent_id, outcome FROM checked"),
        "feed_created": _with(
            HISTORY,
            FEEDS,
            CREATES,
            """SELECT id, parent_id, max_ack, epoch_us(TIMESTAMP '2024-01-01') AS created_us FROM feeds
               UNION ALL SELECT id, parent_id, 0, epoch_us(TIMESTAMP '2024-02-01') FROM checked WHERE outcome = 'created'""",
        ),
        "feed_delete": _with(HISTORY, FEEDS, DELETES, "SELECT ord, id, outcome FROM checked"),
        "feed_deleted": _with(
            HISTORY,
            FEEDS,
            DELETES,
            "SELECT id FROM feeds WHERE id NOT IN (SELECT id FROM checked WHERE outcome = 'deleted')",
        ),
        "feed_acks": _with(HISTORY, FEEDS, ACKS, "SELECT id, max_ack, last_ack_us FROM after_acks"),
        "ack_rejects": _with(
            HISTORY, FEEDS, ACKS, "SELECT ord, id, ack, outcome FROM checked WHERE outcome <> 'accepted'"
        ),
        "ack_progress": _with(
            HISTORY, FEEDS, ACKS, "SELECT id, max_ack FROM after_acks WHERE max_ack > old_ack"
        ),
        "children_woken": _with(HISTORY, FEEDS, PARENT_ACKS, "SELECT id, parent_id, bound FROM woken"),
        "woken_poll": _with(
            HISTORY,
            FEEDS,
            PARENT_ACKS,
            """SELECT r.id AS feed, h.type, h.id, h.seq
               FROM registry r JOIN woken w ON w.id = r.id AND w.bound > greatest(r.parent_max_ack, r.max_ack)
               JOIN history h ON h.seq > r.max_ack AND h.seq <= w.bound
               WHERE r.type_filter IS NULL OR list_contains(r.type_filter, h.type)
               QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY h.seq) <= 10""",
        ),
        "feed_registry_maintained": _with(HISTORY, FEEDS, f"SELECT {registry_row} FROM registry"),
        "feed_poll": _with(HISTORY, FEEDS, POLL, "SELECT feed, type, id, seq FROM delivered"),
        "feed_second_poll": _with(
            HISTORY,
            FEEDS,
            POLL,
            """SELECT c.id AS feed, h.type, h.id, h.seq
               FROM cursors c JOIN history h ON h.seq > c.from_ack AND h.seq <= c.parent_max_ack
               WHERE c.type_filter IS NULL OR list_contains(c.type_filter, h.type)
               QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY h.seq) BETWEEN 11 AND 14""",
        ),
        "feed_next_cursor": _with(
            HISTORY,
            FEEDS,
            POLL,
            """SELECT id, from_ack, parent_max_ack, CAST(inflight AS INTEGER) AS inflight,
                      CASE WHEN inflight >= 10 THEN 'BufferFull' WHEN from_ack >= parent_max_ack THEN 'AtHead' ELSE 'Fetching' END AS state
               FROM advanced""",
        ),
        "feed_states": _with(
            HISTORY,
            FEEDS,
            "SELECT id, CASE WHEN max_ack >= parent_max_ack THEN 'AtHead' ELSE 'Fetching' END AS state FROM registry",
        ),
        "feed_cursor_acks": _with(
            HISTORY,
            FEEDS,
            POLL,
            """SELECT id, CASE WHEN known THEN max_ack + 3 ELSE max_ack END AS max_ack,
                      CAST(CASE WHEN known THEN len(list_filter(seqs, lambda s: s > max_ack + 3)) ELSE inflight END AS INTEGER) AS inflight,
                      NOT known AS failed
               FROM (SELECT *, coalesce(list_contains(seqs, max_ack + 3), false) AS known FROM advanced)""",
        ),
        "inflight_ack_fold": """
            WITH acks AS (SELECT event_id AS ord, CAST(user_id AS VARCHAR) AS id, CAST(props->>'k' AS BIGINT) AS ack, event_type FROM events),
            sent AS (SELECT DISTINCT id, ack FROM acks WHERE event_type <> 'error'),
            judged AS (
              SELECT a.ord, a.id, a.ack, coalesce(max(a.ack) OVER (PARTITION BY a.id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position,
                     s.id IS NOT NULL AS was_sent
              FROM acks a LEFT JOIN sent s ON s.id = a.id AND s.ack = a.ack
            ),
            owned AS (SELECT *, CASE WHEN ack <= position THEN 'stale' WHEN was_sent THEN 'accepted' ELSE 'error' END AS own FROM judged),
            failed AS (SELECT *, min(CASE WHEN own = 'error' THEN ord END) OVER (PARTITION BY id) AS failed_at FROM owned)
            SELECT ord, id, ack, CASE WHEN ord > failed_at THEN NULL ELSE position END AS position,
                   CASE WHEN ord > failed_at THEN 'closed' ELSE own END AS outcome FROM failed""",
        "feed_events_ndjson": _with(
            HISTORY,
            """SELECT '{"eventType":"event","data":{"type":"' || type || '","id":"' || id || '","seq":' || seq ||
                      ',"eventTime":' || epoch_ms(event_time) || '}}' AS value FROM history""",
        ),
        "hydrated_feed": _with(
            EDGES,
            LIVE,
            LIVE_LINKS,
            HISTORY,
            FEEDS,
            POLL,
            "roots AS (SELECT DISTINCT d.type, d.id FROM delivered d SEMI JOIN live l ON l.type = d.type AND l.id = d.id)",
            PAIRS,
            """SELECT h.root_type, h.root_id, h.role, h.type, h.id, l.label
               FROM hydrated h JOIN live l ON l.type = h.type AND l.id = h.id""",
        ),
        "debounce_events": "SELECT event_id, user_id, event_type " + BURSTS.format(rows="events"),
        "debounce_eager": "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' UNION ALL "
        "SELECT event_id, user_id, event_type " + BURSTS.format(rows="events WHERE event_type <> 'error'"),
        "heartbeat": """
            SELECT user_id, CAST(at_us AS BIGINT) AS at_us FROM (
              SELECT user_id, unnest(range(us + 14400000000, next_us, 14400000000)) AS at_us FROM (
                SELECT user_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_us FROM events
              ) WHERE next_us IS NOT NULL)""",
        "validate_batch": _with(BATCHES, "SELECT batch_id, items, verdict FROM verdicts"),
        "accepted_batch_items": _with(
            BATCHES,
            """SELECT l_orderkey AS batch_id, 'part' AS type, CAST(l_partkey AS VARCHAR) AS id FROM lineitem
               WHERE l_orderkey IN (SELECT batch_id FROM verdicts WHERE verdict = 'ok')""",
        ),
        "validate_writes": _with(
            WRITE_FAULTS,
            """SELECT ord, reason, '/data' AS pointer, '{"type":"user","id":"' || path_id || '"}' AS detail
               FROM verdicts WHERE reason IS NOT NULL""",
        ),
        # Text of a readable line is written anew from its columns, which are those of the line in their order.
        "validate_unreadable": r"""
            SELECT CASE WHEN event_type IN ('signup', 'error') THEN event_id END AS ord, 'malformed' AS reason,
                   '{"ord":' || CASE WHEN event_type = 'purchase' THEN '"' || event_id || '"' ELSE event_id::VARCHAR END || ','
                   || CASE event_type WHEN 'signup' THEN '' WHEN 'error' THEN '"op":"patch",' ELSE '"op":"put",' END
                   || '"path_type":"user","path_id":"' || user_id || '","body":"{\"data\":{\"type\":\"user\",\"id\":\"' || user_id || '\"}}"'
                   || CASE event_type WHEN 'view' THEN '' ELSE '}' END AS text
            FROM events WHERE event_type IN ('view', 'signup', 'error', 'purchase')""",
        "accepted_writes": _with(
            WRITE_FAULTS,
            "SELECT ord, 'user' AS type, path_id AS id, 'part/' || k AS refs FROM verdicts WHERE reason IS NULL",
        ),
        "validate_documents": "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'nested_member' END AS fault FROM documents",
        "validate_changefeeds": """
            SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'type_filter' WHEN 'FURNITURE' THEN 'type_filter'
                                                WHEN 'MACHINERY' THEN 'parent_type' END AS fault FROM customer""",
    }
