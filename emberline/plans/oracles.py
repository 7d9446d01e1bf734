"""DuckDB SQL that each query's result must equal, written on its own terms."""

EVENTS = """ev AS (
    SELECT *, epoch_us(ts) / 1e6::DOUBLE AS seconds, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS tick FROM events
)"""
TICKS = f"""{EVENTS}, ticks AS (
    SELECT user_id AS trace_id, tick, seconds AS ts, least(value / 100, 1.0::DOUBLE) AS p, event_type = 'signup' AS gated,
        CASE WHEN event_type = 'signup' THEN 'complete' ELSE 'printing' END AS state, 'f' || CAST(event_id // 2500 AS VARCHAR) AS filename
    FROM ev
)"""
RECORDS = f"""{EVENTS}, ticks AS (
    SELECT user_id AS trace_id, tick, seconds AS ts, least(value / 100, 1.0::DOUBLE) AS p, event_type = 'signup' AS gated, 'printing' AS state, 'calibration' AS filename FROM ev
)"""
DOCS = """docs AS (
    SELECT source || ':' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS uid, doc_id, source, lang, n_chars, sha256(coalesce(text, '')) AS content_hash,
        CAST('0x' || substr(md5(substr(coalesce(text, ''), 0 * CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) + 1, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT))), 1, 4) || substr(md5(substr(coalesce(text, ''), 1 * CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) + 1, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT))), 1, 4) || substr(md5(substr(coalesce(text, ''), 2 * CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) + 1, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT))), 1, 4) || substr(md5(substr(coalesce(text, ''), 3 * CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) + 1, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT))), 1, 3) AS BIGINT) AS phash
    FROM documents
)"""
PREDICTIONS = """x AS (
    SELECT vec_id, label, list_transform(embedding[1:10], lambda v: round(CAST(v AS DOUBLE) * 8, 3)) AS logits FROM embeddings
), e AS (
    SELECT *, list_transform(logits, lambda v: exp(v - list_max(logits))) AS ex, list_position(logits, list_max(logits)) - 1 AS k FROM x
), p AS (
    SELECT vec_id, logits, k, list_transform(ex, lambda v: v / list_sum(ex)) AS probs, 'c' || CAST(label AS VARCHAR) AS y_true,
        'c' || CAST(CASE WHEN vec_id % 2 = 0 THEN label ELSE k END AS VARCHAR) AS y_pred, CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS source
    FROM e
)"""
POINTS = f"""{PREDICTIONS}, r AS (SELECT y_true = 'c1' AS t, k = 1 AS a, round(probs[2], 6) AS q FROM p),
th AS (SELECT round(0.05::DOUBLE + i * 0.05::DOUBLE, 10) AS threshold FROM range(19) g(i)),
points AS (
    SELECT threshold, count(*) FILTER (a AND q >= threshold AND t) AS tp, count(*) FILTER (a AND q >= threshold AND NOT t) AS fp,
        count(*) FILTER (NOT (a AND q >= threshold) AND t) AS fn, count(*) FILTER (NOT (a AND q >= threshold) AND NOT t) AS tn FROM r, th GROUP BY threshold
), pts AS (
    SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS recall FROM points
)"""
CLUSTERS = """cl AS (
    SELECT n_regionkey AS label, 'k' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS cluster, count(*) AS size
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL
)"""
UNIQUE = f"{DOCS}, uq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY uid) AS rn FROM docs) WHERE rn = 1)"
NEAR = f"""{UNIQUE}, edge AS (SELECT a.uid AS a, b.uid AS b FROM uq a JOIN uq b ON a.uid <> b.uid AND bit_count(xor(a.phash, b.phash)) <= 6),
reach AS (SELECT uid AS a, uid AS b FROM uq UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
cl AS (SELECT uq.*, c.cluster FROM uq JOIN (SELECT a, min(b) AS cluster FROM reach GROUP BY a) c ON c.a = uq.uid)"""
NAMES = """nm AS (
    SELECT o_orderkey, CASE o_orderkey % 7
        WHEN 0 THEN 'Image_' || st || '123_aug.jpg' WHEN 1 THEN 'cam_' || st[1:8] || '_' || st[9:14] || '.PNG' WHEN 2 THEN 'frame_' || o_orderkey || '.rf.0a1b2c3d.jpg'
        WHEN 3 THEN 'cam_v2_x' || o_orderkey || '__y.jpeg' WHEN 4 THEN 'bad_99999999999999_' || o_custkey || '.jpg' WHEN 5 THEN 'fdm_plain_original_aug' ELSE 's.dotted.' || o_orderkey || '-end.jpg' END AS name
    FROM (SELECT *, strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y%m%d%H%M%S') AS st FROM orders)
), stems AS (SELECT *, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem FROM nm)"""

STEMS = """st AS (
    SELECT o_orderkey % 3 AS source, CASE WHEN o_orderkey % 2 = 1 THEN 'Image_' || strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y%m%d%H%M%S') || '123' ELSE 'cam' || (o_custkey % 5) || '_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS stem,
        CASE WHEN o_orderkey % 2 = 0 THEN 'cam' || (o_custkey % 5) || '_|' END AS family, CASE WHEN o_orderkey % 2 = 1 THEN CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 ELSE o_orderkey END AS moment
    FROM orders
)"""


def machine(source: str, configs: str) -> str:
    """The decision operator over `ticks`, one recursion per trace and configuration; the result is the view `m`."""
    return f"""WITH RECURSIVE {source}, cfg AS ({configs}), m AS (
        SELECT t.trace_id, c.config, CAST(-1 AS BIGINT) AS tick, 0.0::DOUBLE AS ts, 0.0::DOUBLE AS score, CAST([] AS BOOLEAN[]) AS win, 0 AS wr, 0 AS pr, 0 AS cr, false AS latch,
            'idle' AS st, 0.0::DOUBLE AS until_ts, 0 AS clr, CAST(NULL AS VARCHAR) AS pstate, CAST(NULL AS VARCHAR) AS pfile,
            'none' AS action, 'idle' AS state, 0 AS votes, 0 AS consecutive, CAST(NULL AS VARCHAR) AS level, false AS gated
        FROM (SELECT DISTINCT trace_id FROM ticks) t, cfg c
        UNION ALL
        SELECT trace_id, config, tick, ts, score, win, wr, pr, cr, latch,
            CASE WHEN gated THEN st WHEN holds THEN 'cooldown' WHEN level IS NOT NULL THEN 'cooldown' WHEN wok THEN 'warning' ELSE 'armed' END,
            CASE WHEN NOT gated AND level IS NOT NULL THEN ts + cooldown_s ELSE until_ts END,
            CASE WHEN gated THEN clr WHEN level IS NOT NULL THEN 0 ELSE clr1 END,
            pstate, pfile,
            CASE WHEN gated OR holds THEN 'none' WHEN level IS NOT NULL THEN CASE WHEN mode = 'pause' AND level = 'cancel' THEN 'pause' ELSE level END WHEN wok AND NOT latch0 THEN 'notify' ELSE 'none' END,
            CASE WHEN gated THEN st WHEN holds THEN 'cooldown' WHEN level IS NOT NULL THEN 'triggered' WHEN wok THEN 'warning' ELSE 'armed' END,
            votes,
            CASE WHEN gated THEN 0 WHEN holds THEN pr WHEN level = 'cancel' THEN cr WHEN level = 'pause' THEN pr ELSE wr END,
            CASE WHEN gated OR holds THEN NULL ELSE level END, gated
        FROM (
            SELECT *, CASE WHEN gated OR holds THEN NULL WHEN cr >= cancel_n THEN 'cancel' WHEN pr >= pause_n THEN 'pause' END AS level FROM (
                SELECT *, NOT gated AND st = 'cooldown' AND NOT (ts >= until_ts AND clr1 >= clear_ticks) AS holds FROM (
                    SELECT *, CASE WHEN NOT gated AND st = 'cooldown' THEN CASE WHEN score < 0.40::DOUBLE THEN clr + 1 ELSE 0 END ELSE clr END AS clr1,
                        CASE WHEN gated THEN wr0 WHEN wok THEN wr0 + 1 ELSE 0 END AS wr, CASE WHEN gated THEN pr0 WHEN pok THEN pr0 + 1 ELSE 0 END AS pr,
                        CASE WHEN gated THEN cr0 WHEN cok THEN cr0 + 1 ELSE 0 END AS cr, CASE WHEN gated THEN latch0 ELSE wok END AS latch
                    FROM (
                        SELECT *, score > warn_score AND votes >= 3 AS wok, score > pause_score AND votes >= pause_votes AS pok, score > 0.70::DOUBLE AND votes >= 5 AS cok FROM (
                            SELECT *, CAST(len(list_filter(win, lambda x: x)) AS INTEGER) AS votes FROM (
                                SELECT *, CASE WHEN gated THEN s0 ELSE alpha * p + (1.0::DOUBLE - alpha) * s0 END AS score,
                                    CASE WHEN gated THEN w0 ELSE list_append(w0, p > 0.55::DOUBLE)[-12:] END AS win
                                FROM (
                                    SELECT t.trace_id, c.*, t.tick, t.ts, t.p, t.gated, t.state AS pstate, t.filename AS pfile,
                                        CASE WHEN rs THEN 0.0::DOUBLE ELSE q.score END AS s0, CASE WHEN rs THEN CAST([] AS BOOLEAN[]) ELSE q.win END AS w0,
                                        CASE WHEN rs THEN 0 ELSE q.wr END AS wr0, CASE WHEN rs THEN 0 ELSE q.pr END AS pr0, CASE WHEN rs THEN 0 ELSE q.cr END AS cr0,
                                        CASE WHEN rs THEN false ELSE q.latch END AS latch0, CASE WHEN rs THEN 'idle' ELSE q.st END AS st,
                                        CASE WHEN rs THEN 0.0::DOUBLE ELSE q.until_ts END AS until_ts, CASE WHEN rs THEN 0 ELSE q.clr END AS clr
                                    FROM (SELECT m.*, t2.state AS ns, t2.filename AS nf,
                                            m.pstate IS NOT NULL AND t2.state IS NOT NULL AND (coalesce(m.pfile <> t2.filename, false) OR (m.pstate = 'printing' AND t2.state IN ('complete', 'cancelled', 'error', 'standby'))) AS rs
                                          FROM m JOIN ticks t2 ON t2.trace_id = m.trace_id AND t2.tick = m.tick + 1) q
                                    JOIN ticks t ON t.trace_id = q.trace_id AND t.tick = q.tick + 1 JOIN cfg c ON c.config = q.config
                                )
                            )
                        )
                    )
                )
            )
        )
    )"""


ONE = "SELECT 'one' AS config, 0.35::DOUBLE AS alpha, 0.5::DOUBLE AS warn_score, 0.6::DOUBLE AS pause_score, 4 AS pause_votes, 2 AS pause_n, 2 AS cancel_n, 86400.0::DOUBLE AS cooldown_s, 2 AS clear_ticks, '{mode}' AS mode"
GRID = """SELECT lpad(CAST(row_number() OVER (ORDER BY i, j, k) - 1 AS VARCHAR), 5, '0') AS config, alpha, 0.5::DOUBLE AS warn_score, pause_score, pause_votes, 2 AS pause_n, 2 AS cancel_n, 86400.0::DOUBLE AS cooldown_s, 2 AS clear_ticks, 'pause' AS mode
    FROM (VALUES (0, 0.55::DOUBLE), (1, 0.65::DOUBLE)) a(i, pause_score), (VALUES (0, 4), (1, 6)) b(j, pause_votes), (VALUES (0, 0.35::DOUBLE), (1, 0.6::DOUBLE)) c(k, alpha)"""
JUDGED = """, g AS (
    SELECT trace_id, config, count(*) AS n_ticks, max(ts) - min(ts) AS duration_s, count(*) FILTER (action <> 'none') AS n_actions, count(*) FILTER (action = 'notify') AS n_notify,
        count(*) FILTER (action = 'pause') AS n_pause, count(*) FILTER (action <> 'none' AND tick < 30) AS false_positives, bool_or(action <> 'none' AND tick >= 30) AS detected,
        min(ts) FILTER (action <> 'none' AND tick >= 30) - min(ts) FILTER (tick = 30) AS time_to_detect_s
    FROM m WHERE tick >= 0 GROUP BY trace_id, config
)"""
ROLLED = """, roll AS (
    SELECT config, count(*) AS n_traces, CAST(sum(n_ticks) AS BIGINT) AS total_ticks, CAST(sum(n_actions) AS BIGINT) AS total_actions, CAST(sum(n_notify) AS BIGINT) AS n_notify, CAST(sum(n_pause) AS BIGINT) AS n_pause,
        CAST(sum(false_positives) AS BIGINT) AS false_positives, sum(duration_s) / 3600 AS hours, avg(time_to_detect_s) AS ttd, avg(CAST(detected AS INTEGER)::DOUBLE) AS det
    FROM g GROUP BY config
), told AS (
    SELECT config, n_traces, total_ticks, total_actions, n_notify, n_pause, false_positives, round(hours, 4) AS total_hours, round(CASE WHEN hours > 0 THEN false_positives / hours ELSE 0.0 END, 6) AS fp_per_hour,
        round(ttd, 1) AS mean_time_to_detect_s, round(det, 6) AS detected_fraction FROM roll
)"""
SWEEP = machine(RECORDS, GRID) + JUDGED + ROLLED

ORACLES = {
    "decision_replay": machine(TICKS, ONE.format(mode="cancel")) + " SELECT trace_id, tick, action, state, score, votes, consecutive, level, gated FROM m WHERE tick >= 0",
    "replay_traces": machine(RECORDS, ONE.format(mode="pause")) + JUDGED + " SELECT trace_id, n_ticks, n_actions, n_notify, n_pause, false_positives, detected, round(duration_s, 3) AS duration_s, round(time_to_detect_s, 3) AS time_to_detect_s FROM g",
    "replay_sweep": SWEEP + " SELECT * FROM told",
    "replay_best": SWEEP + " SELECT told.* FROM told JOIN roll USING (config) ORDER BY told.fp_per_hour, roll.ttd NULLS LAST, config LIMIT 1",
    "actions_by_type": SWEEP + " SELECT config, 'notify' AS action, n_notify AS n FROM told WHERE n_notify > 0 UNION ALL SELECT config, 'pause', n_pause FROM told WHERE n_pause > 0",
    "ema_score": f"""WITH RECURSIVE {EVENTS}, r AS (
        SELECT user_id, event_id, tick, 0.35::DOUBLE * least(value / 100, 1.0::DOUBLE) + (1.0::DOUBLE - 0.35::DOUBLE) * 0.0::DOUBLE AS score FROM ev WHERE tick = 0
        UNION ALL SELECT ev.user_id, ev.event_id, ev.tick, 0.35::DOUBLE * least(value / 100, 1.0::DOUBLE) + (1.0::DOUBLE - 0.35::DOUBLE) * r.score FROM r JOIN ev ON ev.user_id = r.user_id AND ev.tick = r.tick + 1
    ) SELECT user_id, event_id, score FROM r""",
    "votes_and_runs": f"""WITH {EVENTS}, a AS (SELECT user_id, event_id, least(value / 100, 1.0::DOUBLE) AS p FROM ev),
        v AS (SELECT *, CAST(sum(CAST(p > 0.55::DOUBLE AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS INTEGER) AS votes FROM a),
        o AS (SELECT *, p > 0.5::DOUBLE AND votes >= 3 AS w, p > 0.6::DOUBLE AND votes >= 4 AS q, p > 0.7::DOUBLE AND votes >= 5 AS c FROM v),
        i AS (SELECT *, sum(CAST(NOT w AS INTEGER)) OVER u AS iw, sum(CAST(NOT q AS INTEGER)) OVER u AS iq, sum(CAST(NOT c AS INTEGER)) OVER u AS ic, coalesce(lag(w) OVER u, false) AS before FROM o WINDOW u AS (PARTITION BY user_id ORDER BY event_id))
        SELECT user_id, event_id, votes, CAST(sum(CAST(w AS INTEGER)) OVER (PARTITION BY user_id, iw ORDER BY event_id) AS INTEGER) AS warn_run, CAST(sum(CAST(q AS INTEGER)) OVER (PARTITION BY user_id, iq ORDER BY event_id) AS INTEGER) AS pause_run,
            CAST(sum(CAST(c AS INTEGER)) OVER (PARTITION BY user_id, ic ORDER BY event_id) AS INTEGER) AS cancel_run, w AND NOT before AS notify_edge FROM i""",
    "identity_epochs": f"""WITH {TICKS}, r AS (
        SELECT *, CAST(coalesce(filename <> lag(filename) OVER u, false) OR coalesce(lag(state) OVER u = 'printing' AND state = 'complete', false) AS INTEGER) AS reset FROM ticks WINDOW u AS (PARTITION BY trace_id ORDER BY tick)
    ) SELECT trace_id, tick, CAST(sum(reset) OVER (PARTITION BY trace_id ORDER BY tick) AS BIGINT) AS epoch FROM r""",
    "rate_limit": f"""WITH RECURSIVE {EVENTS}, e AS (SELECT user_id, event_id, seconds, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM ev),
        r AS (SELECT user_id, event_id, k, seconds AS last, true AS sent FROM e WHERE k = 1
            UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.seconds - r.last >= 21600 THEN e.seconds ELSE r.last END, e.seconds - r.last >= 21600 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
        SELECT user_id, event_id, sent FROM r""",
    "asof_state": """SELECT v.user_id, v.event_id, coalesce(p.event_id, -1) AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'view') v
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.event_id >= p.event_id""",
    "state_polls": """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
        r AS (SELECT user_id, event_id, k, event_id AS last, true AS polls FROM e WHERE k = 1
            UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.event_id - r.last >= 500 THEN e.event_id ELSE r.last END, e.event_id - r.last >= 500 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
        SELECT user_id, event_id, polls FROM r""",
    "recorded_frames": "SELECT CAST(min(event_id) AS DOUBLE) AS ts, 'printing' AS state FROM events WHERE event_type <> 'signup' GROUP BY event_id // 7",
    "raw_boxes": """WITH r AS (
            SELECT [l_quantity / 50, l_tax * 10, l_discount * 10] AS s, (l_quantity * 8 - 4) * 2 AS x1, (l_quantity * 12 - 4) * 2 AS x2, (l_tax * 1000 + l_discount * 1000) * 2 AS y2 FROM lineitem
        ), c AS (SELECT *, list_max(s) AS conf, ['a', 'b', 'c'][list_position(s, list_max(s))] AS class_name FROM r)
        SELECT class_name, CASE WHEN class_name = 'a' THEN 'catastrophic' ELSE 'cosmetic' END AS severity, count(*) AS n, round(sum(greatest(0, least(639, x1))), 2) AS x1, round(sum(greatest(0, least(639, x2))), 2) AS x2, round(sum(greatest(0, least(479, y2))), 2) AS y2
        FROM c WHERE conf >= CASE class_name WHEN 'a' THEN 0.9 ELSE 0.25 END GROUP BY class_name""",
    "suppressed_boxes": """WITH RECURSIVE b AS (SELECT l_orderkey AS f, CAST(l_quantity AS DOUBLE) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice + l_linenumber / 1000 DESC) AS i FROM lineitem),
        s AS (SELECT f, i, [q] AS kept FROM b WHERE i = 1
            UNION ALL SELECT s.f, b.i, CASE WHEN len(list_filter(s.kept, lambda k: power(greatest(0, 20 - abs(k - b.q)), 2) > 0.45::DOUBLE * (800 - power(greatest(0, 20 - abs(k - b.q)), 2)))) = 0 THEN list_append(s.kept, b.q) ELSE s.kept END
            FROM s JOIN b ON b.f = s.f AND b.i = s.i + 1)
        SELECT f AS frame_id, len(arg_max(kept, i)) AS n_kept FROM s GROUP BY f""",
    "assigned_groups": f"""WITH RECURSIVE {DOCS}, edge AS (
            SELECT a.uid AS a, b.uid AS b FROM docs a JOIN docs b ON a.uid <> b.uid AND (a.content_hash = b.content_hash OR bit_count(xor(a.phash, b.phash)) <= 6 OR (a.source = b.source AND a.doc_id // 3 = b.doc_id // 3 AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 0))
        ), reach AS (SELECT uid AS a, uid AS b FROM docs UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
        root AS (SELECT a AS uid, min(b) AS root FROM reach GROUP BY a)
        SELECT uid, 'g' || lpad(CAST(dense_rank() OVER (ORDER BY root) - 1 AS VARCHAR), 6, '0') AS "group" FROM root""",
    "name_groups": f"""WITH {STEMS}, t AS (SELECT DISTINCT source, stem, family, moment FROM st),
        g AS (SELECT *, lag(moment) OVER w AS before FROM t WINDOW w AS (PARTITION BY source, family ORDER BY moment, stem)),
        n AS (SELECT *, CAST(sum(CASE WHEN moment - before > CASE WHEN family IS NULL THEN 86400 ELSE 30 END THEN 1 ELSE 0 END) OVER (PARTITION BY source, family ORDER BY moment, stem ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS k FROM g)
        SELECT source, stem, CASE WHEN family IS NULL THEN 'ts' || lpad(k, 5, '0') ELSE 'seq:' || family || ':' || lpad(k, 5, '0') END AS session FROM n""",
    "capture_groups": f"""WITH {STEMS}, t AS (SELECT stem, moment, count(*) AS n FROM st WHERE family IS NULL GROUP BY ALL),
        g AS (SELECT *, lag(moment) OVER (ORDER BY moment) AS before FROM t),
        k AS (SELECT *, CAST(sum(CASE WHEN moment - before > 7200 THEN 1 ELSE 0 END) OVER (ORDER BY moment ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS k FROM g)
        SELECT stem, 'session' || lpad(k, 5, '0') AS session, n FROM k UNION ALL SELECT stem, 'unparsed:' || stem, count(*) FROM st WHERE family IS NOT NULL GROUP BY stem""",
    "first_addresses": """SELECT o_orderkey, 'train' AS split, 'https://h/' || o_orderkey || '/0' AS url FROM orders
        UNION ALL SELECT o_orderkey, 'val', 'https://h/v' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0""",
    "file_summary": "SELECT 'd' || (o_orderkey % 5) AS directory, CASE WHEN o_orderkey % 2 = 0 THEN 'jpg' ELSE 'png' END AS ext, count(*) AS n FROM orders GROUP BY 1, 2",
    "gate_reasons": f"WITH {TICKS} SELECT CASE WHEN state <> 'printing' THEN 'not_printing' WHEN tick < 5 THEN 'warmup' WHEN p < 0.05::DOUBLE THEN 'quality:blurred' END AS reason, count(*) AS n FROM ticks GROUP BY 1",
    "clamped_actions": """WITH a AS (SELECT CASE WHEN value > 80 THEN 'cancel' WHEN value > 60 THEN 'pause' WHEN value > 40 THEN 'notify' ELSE 'none' END AS action FROM events)
        SELECT mode, CASE WHEN mode = 'notify_only' AND action IN ('pause', 'cancel') THEN 'notify' WHEN mode = 'pause' AND action = 'cancel' THEN 'pause' ELSE action END AS clamped, count(*) AS n
        FROM a, (VALUES ('notify_only'), ('pause'), ('cancel')) v(mode) GROUP BY 1, 2""",
    "quality_gate": """SELECT CASE WHEN l_tax * 100 > 5.0 THEN 'stale' WHEN l_quantity * 5 < 20 THEN 'too_dark' WHEN l_quantity * 5 > 240 THEN 'too_bright' WHEN l_discount * 1000 < 45 THEN 'blurred' ELSE 'passed' END AS reason, count(*) AS n
        FROM lineitem GROUP BY 1""",
    "failure_scores": """SELECT l_orderkey, CAST(count(*) FILTER (l_returnflag <> 'R') AS INTEGER) AS n_cosmetic, coalesce(max(l_quantity / 50) FILTER (l_returnflag = 'R'), 0.0) AS p_failure,
        CAST(coalesce(arg_min(l_linenumber, l_linenumber - 100.0 * l_quantity) FILTER (l_returnflag = 'R'), -1) AS INTEGER) AS top_class FROM lineitem GROUP BY l_orderkey""",
    "classified_frames": f"""WITH {PREDICTIONS}, c AS (SELECT vec_id, CAST(k AS INTEGER) AS class_id, CASE WHEN k = 0 THEN 'normal' ELSE 'c' || k END AS class_name, list_max(probs) AS q FROM p)
        SELECT vec_id, class_id, class_name, round(q, 6) AS confidence, CASE WHEN class_name IN ('c1', 'c3') THEN 'catastrophic' ELSE 'cosmetic' END AS severity
        FROM c WHERE class_name <> 'normal' AND q >= CASE class_name WHEN 'c3' THEN 0.3 WHEN 'c4' THEN 0.05 ELSE 0.12 END""",
    "candidate_boxes": """WITH r AS (
            SELECT ['a', 'b', 'c', 'd'][l_linenumber] AS class_name, l_quantity / 50 AS conf, (l_quantity * 2 - 4) / 0.5 AS x1, (l_quantity * 9 - 4) / 0.5 AS x2, l_discount * 5000 / 0.5 AS y2, l_linenumber FROM lineitem WHERE l_linenumber <= 4
        ) SELECT class_name, CASE WHEN class_name = 'a' THEN 'catastrophic' ELSE 'cosmetic' END AS severity, count(*) AS n, round(sum(greatest(0, least(639, x1))), 2) AS x1, round(sum(greatest(0, least(639, x2))), 2) AS x2, round(sum(greatest(0, least(479, y2))), 2) AS y2
        FROM r WHERE conf > 0 AND conf >= CASE class_name WHEN 'a' THEN 0.9 WHEN 'b' THEN 0.5 ELSE 0.25 END GROUP BY class_name""",
    "exact_dedupe": f"WITH {UNIQUE} SELECT uid, content_hash FROM uq",
    "priority_dedupe": f"""WITH {DOCS}, o AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 WHEN 'src0' THEN 2 WHEN 'src2' THEN 3 ELSE CAST(substr(source, 4) AS INTEGER) END, uid) AS rn FROM docs)
        SELECT uid, source FROM o WHERE rn = 1""",
    "hamming_pairs": f"""WITH {DOCS}, rep AS (SELECT phash, min(uid) AS rep FROM docs GROUP BY phash)
        SELECT least(a.rep, b.rep) AS a, greatest(a.rep, b.rep) AS b FROM rep a JOIN rep b ON a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= 6
        UNION SELECT rep, uid FROM docs JOIN rep USING (phash) WHERE uid <> rep""",
    "near_clusters": f"WITH RECURSIVE {NEAR} SELECT uid, cluster FROM cl",
    "cluster_sizes": f"""WITH RECURSIVE {NEAR}, s AS (SELECT cluster, count(*) AS n FROM cl GROUP BY cluster)
        SELECT count(*) AS count, min(n) AS min, max(n) AS max, round_even(avg(n), 3) AS mean, median(n) AS median FROM s""",
    "straddling_clusters": f"WITH RECURSIVE {NEAR} SELECT cluster, string_agg(DISTINCT source, ',' ORDER BY source) AS splits FROM cl GROUP BY cluster HAVING count(DISTINCT source) > 1",
    "mixed_clusters": f"WITH RECURSIVE {NEAR} SELECT cluster, CAST(count(DISTINCT quality) AS INTEGER) AS n FROM cl JOIN labels USING (doc_id) GROUP BY cluster HAVING count(DISTINCT quality) > 1",
    "component_groups": f"""WITH RECURSIVE {DOCS}, edge AS (
            SELECT DISTINCT a.uid AS a, b.uid AS b FROM docs a JOIN docs b ON a.uid <> b.uid AND (a.content_hash = b.content_hash OR (a.source = b.source AND a.lang = b.lang AND a.n_chars = b.n_chars))
        ), reach AS (SELECT uid AS a, uid AS b FROM docs UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
        root AS (SELECT a AS uid, min(b) AS root FROM reach GROUP BY a)
        SELECT uid, 'g' || lpad(CAST(dense_rank() OVER (ORDER BY root) - 1 AS VARCHAR), 6, '0') AS "group" FROM root""",
    "group_split": f"""WITH {DOCS}, u AS (SELECT DISTINCT content_hash FROM docs), r AS (SELECT *, row_number() OVER (ORDER BY sha256('7:' || content_hash), content_hash) AS k, count(*) OVER () AS n FROM u)
        SELECT content_hash, CASE WHEN k <= round_even(n * 0.6::DOUBLE, 0) THEN 'train' WHEN k <= round_even(n * 0.6::DOUBLE, 0) + round_even(n * 0.25::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM r""",
    "split_overlaps": f"WITH {DOCS} SELECT content_hash, 'train,val' AS splits FROM docs GROUP BY content_hash HAVING count(*) FILTER (doc_id % 5 = 0) > 0 AND count(*) FILTER (doc_id % 5 <> 0) > 0",
    "greedy_allocation": f"""WITH RECURSIVE {CLUSTERS}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('7:' || cluster), cluster) AS k FROM cl),
        r AS (SELECT label, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, CAST(NULL AS VARCHAR) AS cluster, CAST(0 AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS split FROM (SELECT DISTINCT label FROM cl)
            UNION ALL SELECT label, k, total, CASE WHEN split = 'train' THEN a + size ELSE a END, CASE WHEN split = 'val' THEN b + size ELSE b END, CASE WHEN split = 'test' THEN c + size ELSE c END, cluster, size, split FROM (
                SELECT *, CASE WHEN l1 >= l2 AND l1 >= l3 THEN 'train' WHEN l2 >= l3 THEN 'val' ELSE 'test' END AS split FROM (
                    SELECT o.label, o.k, r.total + o.size AS total, r.a, r.b, r.c, o.cluster, o.size, 0.7::DOUBLE * (r.total + o.size) - r.a AS l1, 0.15::DOUBLE * (r.total + o.size) - r.b AS l2, 0.15::DOUBLE * (r.total + o.size) - r.c AS l3
                    FROM r JOIN o ON o.label = r.label AND o.k = r.k + 1)))
        SELECT label, cluster, size, split FROM r WHERE k > 0""",
    "capped_clusters": f"""WITH RECURSIVE {CLUSTERS}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('7:' || cluster), cluster) AS k FROM cl),
        r AS (SELECT label, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS total, false AS kept, CAST(NULL AS VARCHAR) AS cluster, CAST(0 AS BIGINT) AS size FROM (SELECT DISTINCT label FROM cl)
            UNION ALL SELECT o.label, o.k, CASE WHEN r.total + o.size <= 500 THEN r.total + o.size ELSE r.total END, r.total + o.size <= 500, o.cluster, o.size FROM r JOIN o ON o.label = r.label AND o.k = r.k + 1)
        SELECT label, cluster, size FROM r WHERE kept""",
    "overlap_matrix": f"""WITH {DOCS}, s AS (SELECT DISTINCT source, content_hash FROM docs), n AS (SELECT source, count(*) AS n FROM s GROUP BY source),
        x AS (SELECT a.source AS a, b.source AS b, count(*) AS shared FROM s a JOIN s b ON a.content_hash = b.content_hash AND a.source < b.source GROUP BY ALL)
        SELECT a.source AS a, b.source AS b, a.n AS n_a, b.n AS n_b, coalesce(shared, 0) AS shared, round_even(100.0::DOUBLE * coalesce(shared, 0) / a.n, 2) AS pct_of_a, round_even(100.0::DOUBLE * coalesce(shared, 0) / b.n, 2) AS pct_of_b
        FROM n a JOIN n b ON a.source < b.source LEFT JOIN x ON x.a = a.source AND x.b = b.source""",
    "contained_sources": """WITH s AS (SELECT DISTINCT 's' || (l_suppkey % 6) AS source, l_partkey % 90 AS stem FROM lineitem), n AS (SELECT source, count(*) AS n FROM s GROUP BY source)
        SELECT a.source, b.source AS contained_in, n.n AS n_unique, count(*) AS n_shared, round_even(100.0::DOUBLE * count(*) / n.n, 2) AS pct FROM s a JOIN s b ON a.stem = b.stem AND a.source <> b.source JOIN n ON n.source = a.source
        GROUP BY a.source, b.source, n.n HAVING 100.0 * count(*) / n.n >= 90""",
    "collision_matrix": f"""WITH {DOCS}, c AS (SELECT content_hash, source, count(*) AS n FROM docs GROUP BY ALL)
        SELECT a.source AS a, b.source AS b, CAST(sum(a.n + b.n) AS BIGINT) AS exact FROM c a JOIN c b ON a.content_hash = b.content_hash AND a.source < b.source GROUP BY ALL""",
    "believed_sessions": f"""WITH {DOCS}, s AS (SELECT uid, source AS session, CAST(doc_id // 2 AS VARCHAR) AS stem, phash & CAST('0x0F0F0F000000FFFF' AS BIGINT) AS h FROM docs),
        r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, stem ORDER BY uid) AS rn FROM s) WHERE rn = 1),
        g AS (SELECT session, h, min(uid) AS rep, count(*) AS n FROM r GROUP BY session, h),
        near AS (SELECT DISTINCT a.session, a.rep AS uid FROM g a JOIN g b ON a.session = b.session AND a.h <> b.h AND bit_count(xor(a.h, b.h)) <= 6),
        linked AS (SELECT session, uid FROM near UNION SELECT r.session, r.uid FROM r JOIN g ON g.session = r.session AND g.h = r.h WHERE g.n > 1)
        SELECT v.session, v.n AS n_stems, round(coalesce(l.n, 0) / v.n::DOUBLE, 6) AS share, v.n < 3 OR coalesce(l.n, 0) / v.n::DOUBLE >= 0.02::DOUBLE AS believed
        FROM (SELECT session, count(*) AS n FROM r GROUP BY session) v LEFT JOIN (SELECT session, count(*) AS n FROM linked GROUP BY session) l USING (session)""",
    "sessionize_time": f"""WITH {EVENTS}, s AS (SELECT user_id, event_id, CAST(coalesce(seconds - lag(seconds) OVER u > 21600, true) AS INTEGER) AS n FROM ev WINDOW u AS (PARTITION BY user_id ORDER BY seconds, event_id))
        SELECT user_id, event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS session FROM s""",
    "sessionize_sequence": """WITH s AS (SELECT o_custkey, o_orderkey, CAST(coalesce(o_orderkey - lag(o_orderkey) OVER u > 900, true) AS INTEGER) AS n FROM orders WINDOW u AS (PARTITION BY o_custkey ORDER BY o_orderkey))
        SELECT o_custkey, o_orderkey, CAST(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS session FROM s""",
    "representatives": f"WITH {DOCS} SELECT content_hash, arg_min(uid, sha256('1337:' || content_hash || ':' || uid) || uid) AS uid FROM docs GROUP BY content_hash",
    "sampled": "SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('11:' || p_partkey), p_partkey) AS r FROM part) WHERE r <= 3",
    "stratified_sample": """WITH c AS (SELECT seg, 42 // count(*) OVER () + CAST(row_number() OVER (ORDER BY seg) <= 42 % count(*) OVER () AS INTEGER) AS n FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer))
        SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('11:' || c_custkey), c_custkey) AS r FROM customer) JOIN c ON seg = c_mktsegment WHERE r <= n""",
    "budgeted_selection": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS priority FROM orders ORDER BY priority, sha256('11:' || o_orderkey), o_orderkey LIMIT 200",
    "split_files": """WITH f AS (SELECT l_orderkey AS g, lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || '_' || CAST(l_linenumber AS VARCHAR) AS name FROM lineitem),
        u AS (SELECT *, row_number() OVER (ORDER BY sha256('5:' || g), g) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM f)),
        s AS (SELECT g, CASE WHEN k <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN k <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM u),
        j AS (SELECT split, name, row_number() OVER (PARTITION BY g ORDER BY name) AS rn FROM f JOIN s USING (g))
        SELECT split, count(*) AS n, min(name) AS first, max(name) AS last FROM j WHERE split = 'train' OR rn = 1 GROUP BY split""",
    "split_tallies": f"""WITH {DOCS}, s AS (SELECT *, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM docs)
        SELECT split, count(DISTINCT source) AS n_groups, count(*) AS n_rows, count(*) FILTER (lang = 'de') AS n_de, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang = 'es') AS n_es, count(*) FILTER (lang = 'fr') AS n_fr FROM s GROUP BY split""",
    "balanced_batches": """WITH r AS (SELECT p_partkey, 'c' || (p_partkey % 4 % 3) AS cls FROM part),
        q AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY sha256('3:' || p_partkey), p_partkey) - 1 AS k, count(*) OVER (PARTITION BY cls) AS n FROM r),
        s AS (SELECT i // 8 AS step, i % 8 AS slot, ['c0', 'c1', 'c2'][i % 3 + 1] AS cls, i // 3 AS draw FROM range(64) g(i))
        SELECT step, slot, s.cls, p_partkey FROM s JOIN q ON q.cls = s.cls AND q.k = s.draw % q.n""",
    "pooled_union": """WITH a AS (SELECT o_custkey AS filename, o_orderkey % 2 AS split_rank, min(o_orderkey) AS v FROM orders GROUP BY ALL)
        SELECT filename, v, CAST(split_rank AS INTEGER) AS split_rank, n_copies FROM (SELECT *, count(*) OVER (PARTITION BY filename) AS n_copies, row_number() OVER (PARTITION BY filename ORDER BY split_rank) AS rn FROM a) WHERE rn = 1""",
    "confusion_matrix": f"WITH {PREDICTIONS}, c AS (SELECT 'c' || i AS y_true FROM range(10) g(i)) SELECT c.y_true, " + ", ".join(f"count(*) FILTER (p.y_pred = 'c{k}') AS c{k}" for k in range(10)) + " FROM c LEFT JOIN p USING (y_true) GROUP BY c.y_true",
    "top1_accuracy": f"WITH {PREDICTIONS} SELECT coalesce(avg(CAST(y_true = y_pred AS INTEGER)::DOUBLE), 0.0) AS accuracy FROM p",
}
PRF = f"""WITH {PREDICTIONS}, c AS (SELECT 'c' || i AS class FROM range(10) g(i)), n AS (
    SELECT class, (SELECT count(*) FROM p WHERE y_true = class AND y_pred = class) AS tp, (SELECT count(*) FROM p WHERE y_true = class) AS support, (SELECT count(*) FROM p WHERE y_pred = class) AS predicted_count FROM c
), r AS (SELECT *, CASE WHEN predicted_count > 0 THEN tp / predicted_count::DOUBLE ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0.0 END AS re FROM n),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END AS f1 FROM r)"""
ORACLES |= {
    "per_class_metrics": f"{PRF} SELECT class, round(pr, 9) AS precision, round(re, 9) AS recall, round(f1, 9) AS f1, support, predicted_count FROM f",
    "macro_f1": f"{PRF} SELECT round(avg(f1), 9) AS macro_f1 FROM f",
    "binary_metrics": f"""WITH {PREDICTIONS}, c AS (SELECT count(*) FILTER (y_true <> 'c0' AND y_pred <> 'c0') AS tp, count(*) FILTER (y_true = 'c0' AND y_pred <> 'c0') AS fp, count(*) FILTER (y_true <> 'c0' AND y_pred = 'c0') AS fn, count(*) FILTER (y_true = 'c0' AND y_pred = 'c0') AS tn FROM p)
        SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / (tp + fn)::DOUBLE, 9) AS recall,
            round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE), 9) AS f1, round(fp / (fp + tn)::DOUBLE, 9) AS false_positive_rate FROM c""",
    "threshold_sweep": f"WITH {POINTS} SELECT threshold, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall FROM pts",
    "lowest_threshold": f"""WITH {POINTS}, b AS (SELECT min(threshold) FILTER (precision >= 0.2 AND recall >= 0.05) AS threshold, min(threshold) FILTER (precision >= 0.2 AND recall < 0.05) AS v FROM pts)
        SELECT threshold, CASE WHEN threshold IS NULL THEN v END AS vacuous_threshold FROM b""",
    "best_operating_point": f"WITH {POINTS} SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM pts ORDER BY recall >= 0.02 DESC, CASE WHEN recall >= 0.02 THEN precision ELSE recall END DESC, threshold LIMIT 1",
    "recall_by_source": f"WITH {PREDICTIONS} SELECT source, count(*) AS support, count(*) FILTER (y_true = y_pred) AS correct, round(count(*) FILTER (y_true = y_pred) / count(*)::DOUBLE, 9) AS recall FROM p GROUP BY source",
    "shared_recall_gaps": f"""WITH {PREDICTIONS}, r AS (SELECT y_true AS class, source, avg(CAST(y_true = y_pred AS INTEGER)::DOUBLE) AS recall FROM p GROUP BY ALL)
        SELECT class, count(*) AS n_sources, round(max(recall) - min(recall), 9) AS gap FROM r GROUP BY class HAVING count(*) >= 2""",
    "confound_verdict": f"""WITH {PREDICTIONS}, r AS (SELECT y_true AS class, source, avg(CAST(y_true = y_pred AS INTEGER)::DOUBLE) AS recall FROM p GROUP BY ALL),
        g AS (SELECT class, max(recall) - min(recall) AS gap FROM r GROUP BY class HAVING count(*) >= 2), n AS (SELECT count(DISTINCT source) AS n FROM p)
        SELECT n.n AS n_measured, (SELECT count(*) FROM g) AS n_shared, round((SELECT max(gap) FROM g), 9) AS worst_gap,
            CASE WHEN n.n < 2 THEN 'INCONCLUSIVE' WHEN (SELECT count(*) FROM g) = 0 THEN 'AGGREGATE ONLY' WHEN (SELECT max(gap) FROM g) >= 0.15 THEN 'CONFOUND LIKELY' ELSE 'NO STRONG CONFOUND' END AS verdict FROM n""",
    "pausing_verdict": f"""WITH {POINTS}, s AS (SELECT source, avg(CAST(y_true = y_pred AS INTEGER)::DOUBLE) AS recall FROM p GROUP BY source), g AS (SELECT CASE WHEN count(*) >= 2 THEN max(recall) - min(recall) END AS gap, count(*) AS n FROM s),
        t AS (SELECT min(threshold) FILTER (precision >= 0.2 AND recall >= 0.05) AS threshold FROM pts)
        SELECT round(gap, 9) AS gap, CASE WHEN n <= 1 THEN 'NOT APPLICABLE' WHEN gap IS NULL THEN 'UNDEFINED' WHEN gap >= 0.2 THEN 'LARGE' WHEN gap >= 0.1 THEN 'MODERATE' ELSE 'SMALL' END AS size, threshold IS NOT NULL AND coalesce(gap < 0.2, true) AS fit FROM g, t""",
    "class_support": """SELECT c.class, count(l_orderkey) AS instances, count(DISTINCT l_orderkey) AS images, count(DISTINCT l_partkey) AS source_photos FROM (VALUES ('A'), ('N'), ('R'), ('X')) c(class) LEFT JOIN lineitem ON l_returnflag = c.class GROUP BY c.class""",
    "class_group_support": "SELECT l_returnflag AS class, count(DISTINCT o_custkey) AS groups FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "variant_stats": """WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM s)
        SELECT CAST(sum(n) AS BIGINT) AS num_rows, count(*) AS num_groups, min(n) AS min, median(n) AS median, avg(n) AS mean, max(n) AS max, count(*) FILTER (n > 10) AS num_over_10,
            (SELECT n FROM o WHERE k = least(c - 1, CAST(round_even(0.9::DOUBLE * (c - 1), 0) AS BIGINT))) AS p90 FROM s""",
    "score_gap": """SELECT p_partkey, round(r - d, 9) AS absolute, round(CASE WHEN d > 0 THEN (r - d) / d END, 9) AS relative, coalesce(abs(CASE WHEN d > 0 THEN (r - d) / d END) >= 0.1, false) AS significant, r - d > 0 AS optimistic
        FROM (SELECT p_partkey, p_size / 50::DOUBLE AS d, p_partkey % 50 / 50::DOUBLE AS r FROM part)""",
    "curve_values": """WITH c AS (SELECT p_brand AS class, p_size / 50::DOUBLE AS x, min(p_partkey)::DOUBLE AS y FROM part GROUP BY ALL),
        a AS (SELECT class, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys FROM c GROUP BY class), t AS (SELECT unnest([0.05, 0.3, 0.42, 0.61, 0.9])::DOUBLE AS threshold),
        k AS (SELECT *, len(list_filter(xs, lambda v: v <= threshold)) AS i FROM a, t)
        SELECT class, threshold, round(CASE WHEN i = 0 THEN ys[1] WHEN i = len(xs) THEN ys[-1] ELSE ys[i] + (ys[i + 1] - ys[i]) * ((threshold - xs[i]) / (xs[i + 1] - xs[i])) END, 6) AS value FROM k""",
    "curve_summary": "SELECT p_name AS class, p_size::DOUBLE AS ap FROM part",
    "split_rules": f"""WITH {DOCS}, s AS (SELECT CASE WHEN doc_id % 20 < 18 THEN 'train' WHEN doc_id % 20 = 18 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM docs GROUP BY 1)
        SELECT 'split_imbalance' AS rule, split AS subject FROM s WHERE split <> 'train' AND n / (SELECT sum(n) FROM s)::DOUBLE < 0.15::DOUBLE * 0.6""",
    "class_rules": f"""WITH {DOCS}, s AS (SELECT CASE WHEN doc_id % 3 = 0 AND lang <> 'es' THEN 'val' WHEN doc_id % 3 = 1 THEN 'test' ELSE 'train' END AS split, lang FROM docs),
        c AS (SELECT v.class, count(s.lang) AS n, count(*) FILTER (split = 'val') AS a, count(*) FILTER (split = 'test') AS b FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) v(class) LEFT JOIN s ON s.lang = v.class GROUP BY v.class)
        SELECT 'empty_class' AS rule, class AS subject, 'no instance in any split' AS message FROM c WHERE n = 0 UNION ALL SELECT 'not_evaluable', class, 'not in both val and test' FROM c WHERE n > 0 AND (a = 0 OR b = 0)""",
    "source_rules": f"""WITH {DOCS}, s AS (SELECT source, count(*) AS n, count(DISTINCT doc_id // 80) AS g, count(*) FILTER (n_chars < 100) AS m, count(*) FILTER (lang = 'fr') AS f FROM docs GROUP BY source)
        SELECT 'timelapse' AS rule, source AS subject, n || ' images in ' || g || ' groups' AS message FROM s WHERE n / g::DOUBLE >= 3 UNION ALL
        SELECT 'too_few_groups', source, g || ' groups' FROM s WHERE g < 10 AND source <> 'src0' UNION ALL SELECT 'missing_labels', source, m || ' images without labels' FROM s WHERE m > 0 UNION ALL
        SELECT 'no_suffix', source, f || ' of ' || n || ' names' FROM s WHERE f > 0 AND source <> 'src0'""",
    "scene_rules": f"""WITH {DOCS}, t AS (SELECT count(DISTINCT source) AS n FROM docs), c AS (SELECT row_number() OVER () AS ix, * FROM (SELECT s.s, l.l FROM (VALUES (0, 'train'), (1, 'val'), (2, 'test')) s(i, s), (VALUES (0, 'en'), (1, 'es')) l(j, l) ORDER BY i, j)),
        n AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'train' ELSE 'val' END AS s, lang AS l, count(DISTINCT source) AS n FROM docs GROUP BY ALL),
        r AS (SELECT -1 AS ix, 'only ' || n || ' scenes' AS m FROM t WHERE n < 40 UNION ALL SELECT ix, s || ' has ' || coalesce(n, 0) || ' of ' || l FROM c LEFT JOIN n USING (s, l) WHERE coalesce(n, 0) < 5)
        SELECT count(*) > 0 AS warn, coalesce(string_agg(m, '; ' ORDER BY ix), '') AS reasons FROM r""",
    "session_rules": f"""WITH {DOCS}, r AS (SELECT source AS class, count(DISTINCT doc_id // 200) AS n, count(DISTINCT CASE WHEN doc_id % 9 = 0 THEN doc_id // 400 END) AS v, count(DISTINCT CASE WHEN doc_id % 13 = 0 THEN doc_id // 400 END) AS t FROM docs GROUP BY source),
        w AS (SELECT *, concat_ws(', ', CASE WHEN n < 5 THEN n || ' sessions' END, CASE WHEN v < 2 THEN v || ' val' END, CASE WHEN t < 2 THEN t || ' test' END) AS why FROM r)
        SELECT class, CASE WHEN n < 3 THEN 'not_evaluated' WHEN why <> '' THEN 'weak' ELSE 'fine' END AS verdict, CASE WHEN n >= 3 THEN why ELSE '' END AS reasons FROM w""",
    "data_rules": f"""WITH {DOCS}, c AS (SELECT content_hash, source, count(*) AS n FROM docs GROUP BY ALL),
        x AS (SELECT a.source AS a, b.source AS b, CAST(sum(a.n + b.n) AS BIGINT) AS e FROM c a JOIN c b ON a.content_hash = b.content_hash AND a.source < b.source GROUP BY ALL),
        k AS (SELECT DISTINCT 's' || (p_partkey % 3) AS source, split_part(p_type, ' ', 1) AS name FROM part), o AS (SELECT *, CASE lower(name) WHEN 'economy' THEN 'mapped' WHEN 'large' THEN 'dropped' ELSE 'unmapped' END AS outcome FROM k)
        SELECT 'collision' AS rule, a || '|' || b AS subject, e || ' in exact sets, 0 in near sets' AS message FROM x UNION ALL
        SELECT outcome || '_classes', source, string_agg(name, ', ' ORDER BY name) FROM o WHERE outcome <> 'mapped' GROUP BY outcome, source UNION ALL
        SELECT 'licence_gate', r_name, 'excluded: CC BY-NC 4.0' FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'licence_noncommercial', r_name, 'included: MIT' FROM region WHERE r_regionkey = 4 UNION ALL
        SELECT 'licence_mismatch', r_name, 'MIT but declares GPL' FROM region WHERE r_regionkey = 3 UNION ALL SELECT 'confound_note', 'all', 'check recall by source before trusting pooled scores'""",
    "retention": """WITH r AS (SELECT 'f' || event_id AS path, ts FROM events), m AS (SELECT *, ts < (SELECT max(ts) FROM r) - INTERVAL 20 DAY AS old FROM r),
        k AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY ts DESC, path) AS rn FROM m) SELECT path FROM k WHERE old OR rn > 100""",
    "event_log": f"WITH {EVENTS} SELECT event_id, value AS score, CAST(tick AS INTEGER) AS votes, event_type AS class_name, value AS confidence, 2.0::DOUBLE AS x2 FROM ev",
    "printer_states": """WITH r AS (SELECT *, event_id % 7 = 0 OR event_id % 11 = 0 AS bad FROM events)
        SELECT CASE WHEN bad THEN 'unknown' WHEN event_type = 'view' THEN 'printing' WHEN event_type = 'click' THEN 'paused' WHEN event_type = 'purchase' THEN 'unknown' ELSE 'complete' END AS state, count(*) AS n, count(*) FILTER (NOT bad) AS n_files,
            round(sum(CASE WHEN bad THEN 0 ELSE value END), 3) AS elapsed FROM r GROUP BY 1""",
    "name_keys": f"""WITH {NAMES} SELECT o_orderkey, CASE WHEN regexp_matches(name, '(?i)^(.+)\\.rf\\.[0-9a-f]+\\.(jpg|jpeg|png)$') THEN regexp_extract(name, '(?i)^(.+)\\.rf\\.[0-9a-f]+\\.(jpg|jpeg|png)$', 1) ELSE stem END AS source_id,
            regexp_matches(name, '(?i)^(.+)\\.rf\\.[0-9a-f]+\\.(jpg|jpeg|png)$') AS matched, CASE WHEN length(stem) > 4 AND right(stem, 4) = '_aug' THEN left(stem, -4) WHEN length(stem) > 9 AND right(stem, 9) = '_original' THEN left(stem, -9) ELSE stem END AS capture_key,
            CASE WHEN regexp_matches(lower(stem), '^.+\\.rf\\.[0-9a-f]+$') THEN left(stem, length(stem) - length(split_part(lower(stem), '.rf.', -1)) - 4) ELSE stem END AS export_key,
            CASE WHEN starts_with(name, 'fdm_') THEN 'fdm' WHEN starts_with(name, 'cam_v2_') THEN 'cam_v2' WHEN starts_with(name, 'hf_normal_') THEN 'hf_normal' ELSE 'unknown' END AS origin FROM stems""",
    "name_times": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1) THEN CAST(epoch(o_orderdate) + o_orderkey % 86400 AS BIGINT) ELSE -1 END AS seconds, CASE WHEN o_orderkey % 7 = 0 THEN CAST(epoch(o_orderdate) + o_orderkey % 86400 AS BIGINT) ELSE -1 END AS capture_seconds
        FROM orders""",
    "name_sequences": f"""WITH {NAMES}, s AS (SELECT o_orderkey, regexp_extract(stem, '^(.*[^0-9])?([0-9][0-9]+)([^0-9]*)$', ['a', 'b', 'c']) AS g, stem FROM stems WHERE regexp_matches(stem, '^(.*[^0-9])?([0-9][0-9]+)([^0-9]*)$'))
        SELECT o_orderkey, g.a || '|' || g.c AS family, CAST(g.b AS BIGINT) AS number FROM s""",
    "manifest_sources": f"""WITH {NAMES}, s AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'listed' WHEN 1 THEN '' ELSE CASE WHEN contains(name, '__') THEN split_part(name, '__', 1) END END AS s FROM nm)
        SELECT coalesce(nullif(s, ''), 'unknown') AS source, count(*) AS n FROM s GROUP BY 1""",
    "collision_names": """SELECT o_orderkey, 'img' || o_custkey || CASE WHEN r = 1 THEN '' ELSE '_' || (r - 1) END || '.jpg' AS output FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)""",
    "class_keys": """SELECT trim(lower(p_type)) AS key, CASE lower(split_part(p_type, ' ', 1)) WHEN 'economy' THEN 'mapped' WHEN 'large' THEN 'dropped' ELSE 'unmapped' END AS outcome, CASE lower(split_part(p_type, ' ', 1)) WHEN 'economy' THEN 'warping' END AS class, count(*) AS n
        FROM part GROUP BY ALL""",
    "softmax_argmax": f"WITH {PREDICTIONS} SELECT vec_id, CAST(k AS INTEGER) AS k, round(list_max(probs), 6) AS top, round(list_max(probs), 6) AS kept, true AS agree FROM p",
    "formats": """WITH o AS (SELECT *, CASE WHEN o_orderkey % 60 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 100 / 128::DOUBLE END AS s FROM orders)
        SELECT o_orderkey, CASE WHEN s IS NULL THEN 'n/a' ELSE printf('%.1f%%', floor(s * 1000 + 0.5) / 10) END AS percent, '...' || right('https://h/' || o_orderkey, 6) AS url, 'frame_' || strftime(o_orderdate, '%Y%m%d_%H%M%S_000') || '.jpg' AS frame,
            lpad(lower(to_hex(o_orderkey)), 16, '0') AS hex FROM o""",
    "schedules": """SELECT p_partkey, round(CASE WHEN p_partkey < 100 THEN 0.01 * (p_partkey + 1) / 100.0::DOUBLE ELSE 0.5 * 0.01 * (1 + cos(pi() * least((p_partkey - 100) / 900.0::DOUBLE, 1.0))) END, 9) AS rate, round(least(0.98, (p_partkey + 1) / (p_partkey + 10)::DOUBLE), 9) AS decay
        FROM part""",
    "confidence_order": "SELECT l_orderkey AS frame_id, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_extendedprice DESC, l_linenumber) AS \"order\" FROM lineitem GROUP BY 1",
}
LABELS = """l AS (
    SELECT l_orderkey, l_linenumber AS k, l_quantity / 50 AS q, l_tax AS t, l_discount AS d FROM lineitem
), f AS (SELECT l_orderkey, k, CAST(printf('%.4f', q) AS DOUBLE) AS q, CAST(printf('%.4f', t) AS DOUBLE) AS t, CAST(printf('%.4f', d) AS DOUBLE) AS d FROM l),
c AS (
    SELECT l_orderkey, k, CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS cls,
        CASE k WHEN 1 THEN q - d / 2 WHEN 2 THEN least(q, 0.9::DOUBLE, 1.0) WHEN 3 THEN 0.5 END AS x1, CASE k WHEN 1 THEN t - 0.25 WHEN 2 THEN least(t, d, 0.7) WHEN 3 THEN 0.4 END AS y1,
        CASE k WHEN 1 THEN q + d / 2 WHEN 2 THEN greatest(q, 0.9, 1.2) WHEN 3 THEN 0.5 END AS x2, CASE k WHEN 1 THEN t + 0.25 WHEN 2 THEN greatest(t, d, 0.7) WHEN 3 THEN 0.6 END AS y2
    FROM f
), b AS (SELECT l_orderkey, k, cls, greatest(0, least(1, x1)) AS x1, greatest(0, least(1, y1)) AS y1, greatest(0, least(1, x2)) AS x2, greatest(0, least(1, y2)) AS y2 FROM c)"""
ORACLES |= {
    "label_rows": f"""WITH {LABELS}, g AS (SELECT *, k <= 3 AND x2 > x1 AND y2 > y1 AS solid FROM b)
        SELECT l_orderkey, CAST(count(*) FILTER (solid) AS INTEGER) AS n_rows, CAST(count(*) FILTER (k > 4) AS INTEGER) AS malformed, CAST(count(*) FILTER (k <= 3 AND NOT solid) AS INTEGER) AS degenerate, CAST(count(*) FILTER (solid AND k = 2) AS INTEGER) AS polygons,
            bool_or(k IN (2, 5)) AS has_1, round(coalesce(sum(x1 + 2 * y1 + 3 * x2 + 4 * y2) FILTER (solid), 0), 6) AS digest FROM g GROUP BY l_orderkey""",
    "label_classes": f"WITH {LABELS} SELECT CAST(CASE cls WHEN 2 THEN 0 ELSE 1 END AS INTEGER) AS cls, count(*) AS n FROM b WHERE k <= 2 AND x2 > x1 AND y2 > y1 GROUP BY 1",
}
