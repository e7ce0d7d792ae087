"""DuckDB SQL of the registered queries."""

from __future__ import annotations

KINDS = ("click", "error", "purchase", "signup", "view")

EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events)"
FRAMES = (
    EVENTS + ", fr AS (SELECT (us - 1704067200000000) // 3600000000 AS frame_index, count(*) AS n, "
    + ", ".join(f"sum(CASE WHEN event_type = '{k}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS h{i}" for i, k in enumerate(KINDS))
    + ", avg(value) AS mean_value, var_pop(value) AS lap_var, least(1.0::DOUBLE, avg(value) / 100.0) AS brightness FROM ev GROUP BY 1), pv AS (SELECT *, "
    + ", ".join(f"lag({c}) OVER w AS p_{c}" for c in ("h0", "h1", "h2", "h3", "h4", "brightness", "lap_var", "frame_index"))
    + " FROM fr WINDOW w AS (ORDER BY frame_index)), "
)
_H = range(5)
_m = lambda p: "(" + " + ".join(f"{p}h{i}" for i in _H) + ") / 5.0"
_v = lambda p: "(" + " + ".join(f"{p}h{i} * {p}h{i}" for i in _H) + f") / 5.0 - {_m(p)} * {_m(p)}"
_cov = "(" + " + ".join(f"h{i} * p_h{i}" for i in _H) + f") / 5.0 - {_m('')} * {_m('p_')}"
_chi = "least(1.0, greatest(0.0, 0.5 * (" + " + ".join(f"CASE WHEN h{i} + p_h{i} > 1e-6 THEN (p_h{i} - h{i}) * (p_h{i} - h{i}) / (h{i} + p_h{i}) ELSE 0.0 END" for i in _H) + ")))"
_ssim = f"least(1.0, greatest(0.0, ((2 * {_m('')} * {_m('p_')} + 0.0001) * (2 * ({_cov}) + 0.0009)) / (({_m('')} * {_m('')} + {_m('p_')} * {_m('p_')} + 0.0001) * (({_v('')}) + ({_v('p_')}) + 0.0009))))"
CHANGES = (
    FRAMES + "ch AS (SELECT *, CASE WHEN p_h0 IS NOT NULL THEN " + _chi + " END AS chi2, CASE WHEN p_h0 IS NOT NULL THEN "
    + " + ".join(f"least(h{i}, p_h{i})" for i in _H) + f" END AS overlap, CASE WHEN p_h0 IS NOT NULL THEN {_ssim} END AS ssim, "
    + "CASE WHEN p_h0 IS NOT NULL THEN abs(lap_var - p_lap_var) / greatest(0.01, lap_var, p_lap_var) END AS edge_change, "
    + "CASE WHEN p_h0 IS NOT NULL THEN abs(brightness - p_brightness) ELSE 1.0 END AS delta FROM pv), "
    + "ru AS (SELECT *, CASE WHEN chi2 > 0.42 AND ssim < 0.65 THEN 'HARD_CUT' "
    + "WHEN (p_brightness < 0.08 AND brightness > 0.18) OR (p_brightness > 0.18 AND brightness < 0.08) THEN CASE WHEN brightness > p_brightness THEN 'FADE_IN' ELSE 'FADE_OUT' END "
    + "WHEN chi2 > 0.28 AND ssim < 0.72 AND edge_change < 0.35 THEN 'CROSS_DISSOLVE' WHEN edge_change > 0.65 AND chi2 > 0.28 AND ssim < 0.60 THEN 'ZOOM_TRANSITION' END AS cut, "
    + "lap_var / 1000.0 AS lap, p_lap_var / 1000.0 AS p_lap FROM ch), "
)
BOX = "(event_id % 6) * 150 + (event_id * 37) % 80"
DETECTIONS = (
    EVENTS + ", d0 AS (SELECT user_id % 10 AS video_id, user_id AS person_id, event_id AS det_id, (us - 1704067200000000) // 3600000000 AS frame_index, us, us // 1000 AS timestamp_ms, "
    + f"{BOX} AS l, 700 + (event_id * 53) % 100 AS t, (event_id * 13) % 121 - 60 AS yaw, (event_id * 17) % 81 - 40 AS roll, ((event_id * 19) % 101) / 100.0::DOUBLE AS smile, "
    + "((event_id * 23) % 101) / 100.0::DOUBLE AS le, ((event_id * 29) % 101) / 100.0::DOUBLE AS re, value * 3.0 AS sharpness, event_id % 7 <> 0 AS has_crop, event_id % 5 <> 0 AS clean FROM ev), "
    + "d AS (SELECT *, count(*) OVER (PARTITION BY video_id, frame_index) AS in_frame, count(*) OVER (PARTITION BY video_id, frame_index, l, t) AS same_box FROM d0), "
    + "s0 AS (SELECT *, in_frame = 1 AS solo, in_frame - same_box AS others, sharpness / (sharpness + 150.0) AS sq, greatest(0.0, least(1.0, 1 - (abs(yaw) / 50.0::DOUBLE + abs(roll) / 35.0::DOUBLE))) AS frontality, least(le, re) AS eyes FROM d), "
    + "s AS (SELECT *, least(1.0, greatest(0.0, 0.45 * sq + 0.35 * frontality + 0.20 * (120 / 160.0::DOUBLE))) AS rq, "
    + "0.38 * sq + 0.24 * frontality + 0.18 * (CASE WHEN eyes < 0.35 THEN eyes * 0.2 ELSE eyes END) + 0.10 * smile + 0.08 * (120 / 320.0::DOUBLE) + CASE WHEN solo THEN 0.08 ELSE 0.0 END AS rep, "
    + "l >= 10.8 AND t >= 19.2 AND l + 120 <= 1069.2 AND t + 160 <= 1900.8 AS visible, "
    + "solo AND others = 0 AND l + 60 >= 388.8 AND l + 60 <= 691.2 AND l < 529.2 AND l + 120 > 550.8 AS portrait FROM s0), "
)
GAP, LEAST = 8 * 3_600_000_000, 3_600_000_000
SEGMENTS = (
    DETECTIONS + f"g0 AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY person_id ORDER BY us, det_id) > {GAP} THEN 1 ELSE 0 END AS new FROM s), "
    + "g1 AS (SELECT *, (sum(new) OVER (PARTITION BY person_id ORDER BY us, det_id))::BIGINT AS seg FROM g0), "
    + "g2 AS (SELECT person_id, any_value(video_id) AS video_id, seg, min(us) AS start_us, max(us) AS end_us, count(*) AS n_det, arg_max(sharpness, (round(rep, 9), -det_id)) AS peak, count(DISTINCT frame_index) AS n_frames, "
    + "arg_min(l, (us, det_id)) AS fl, arg_min(t, (us, det_id)) AS ft, arg_max(l, (us, det_id)) AS ll, arg_max(t, (us, det_id)) AS lt FROM g1 GROUP BY person_id, seg), "
    + f"g3 AS (SELECT *, max(CASE WHEN end_us - start_us >= {LEAST} THEN 1 ELSE 0 END) OVER (PARTITION BY person_id) AS any_long, row_number() OVER (PARTITION BY person_id ORDER BY end_us - start_us DESC, seg) AS rn FROM g2), "
    + f"g AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY seg) - 1 AS idx FROM g3 WHERE end_us - start_us >= {LEAST} OR (any_long = 0 AND rn = 1)), "
)
TRACKLETS = "tr AS (SELECT video_id, person_id, person_id * 1048576 + seg AS id, start_us, end_us, n_det, fl, ft, ll, lt FROM g2), "
IDENTITIES = "i AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, (vec_id * 31 % 97) / 96.0::DOUBLE AS q, label AS cohort, vec_id % 25 AS co FROM embeddings), "
IOU = "CASE WHEN least(a.l, b.l) + 120 > greatest(a.l, b.l) AND least(a.t, b.t) + 160 > greatest(a.t, b.t) THEN (least(a.l, b.l) + 120 - greatest(a.l, b.l)) * (least(a.t, b.t) + 160 - greatest(a.t, b.t)) ELSE 0 END"
PAIRS = f"pr AS (SELECT a.video_id, a.frame_index, a.det_id AS a, b.det_id AS b, a.person_id AS pa, b.person_id AS pb, a.l AS al, a.t AS ta, b.l AS bl, b.t AS tb, ({IOU})::DOUBLE AS inter FROM s a JOIN s b ON a.video_id = b.video_id AND a.frame_index = b.frame_index AND a.det_id < b.det_id), "
LONG = "c AS (SELECT cohort, vec_id, q, unnest(range(64)) AS d, unnest(v) AS x FROM i), "
WEIGHTED = LONG + "ws AS (SELECT cohort, d, sum(x * greatest(0.05, q)) AS s, sum(x) AS p, count(*) AS n FROM c GROUP BY cohort, d), wn AS (SELECT cohort, greatest(sqrt(sum(s * s)), 1e-8) AS ns, greatest(sqrt(sum(p * p)), 1e-8) AS np FROM ws GROUP BY cohort), cen AS (SELECT cohort, d, s / ns AS w, p / np AS a FROM ws JOIN wn USING (cohort)), "
SIMS = "sm AS (SELECT a.vec_id AS a, b.vec_id AS b, a.cohort AS ca, b.cohort AS cb, a.co AS fa, b.co AS fb, round(least(1.0, greatest(-1.0, list_dot_product(a.v, b.v))), 12) AS sim FROM i a JOIN i b ON a.vec_id <> b.vec_id), kn AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM sm), "
_GRID = DETECTIONS + "vid AS (SELECT video_id, min(timestamp_ms) AS st, max(timestamp_ms) AS en FROM s GROUP BY video_id), st AS (SELECT video_id, st, en, greatest(400, (en - st) // 28) AS step FROM vid WHERE en > st), gr AS (SELECT video_id, k, st + k * step AS at_ms FROM (SELECT video_id, st, step, unnest(range(0, least(27, (en - st - 1) // step) + 1)) AS k FROM st)), "


def _sql(ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ctes.rstrip().rstrip(",") + " " + body


ORACLE = {
    "q_appearances": _sql(SEGMENTS, "SELECT person_id, count(*) AS appearances FROM g GROUP BY person_id"),
    "q_timeline": _sql(SEGMENTS, "SELECT person_id, idx AS index, start_us, end_us, end_us - start_us AS duration_us, round(peak, 6) AS peak_quality, n_frames FROM g"),
    "q_intervals": _sql(SEGMENTS, "SELECT person_id, string_agg(start_us || '-' || end_us, ',' ORDER BY start_us) AS intervals FROM g GROUP BY person_id"),
    "q_totals": _sql(SEGMENTS, "SELECT count(*) AS unique_people, sum(n)::BIGINT AS total_appearances, arg_max(person_id, (n, -person_id)) AS most_seen FROM (SELECT person_id, count(*) AS n FROM g GROUP BY person_id)"),
    "q_prominence": _sql(SEGMENTS + TRACKLETS, "SELECT video_id, person_id, row_number() OVER (PARTITION BY video_id ORDER BY detections DESC, start_us, person_id)::INT AS rank, detections, start_us FROM (SELECT video_id, person_id, sum(n_det)::BIGINT AS detections, min(start_us) AS start_us FROM tr GROUP BY 1, 2)"),
    "q_tracklet_gaps": _sql(SEGMENTS + TRACKLETS, "SELECT person_id, start_us, sum(new)::BIGINT AS seg_total FROM (SELECT person_id, start_us, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY person_id ORDER BY start_us, id) > 43200000000 THEN 1 ELSE 0 END AS new, id FROM tr) GROUP BY person_id, start_us".replace("sum(new)::BIGINT AS seg_total", "max(new)::BIGINT AS new_segment")),
    "q_grid_sampling": _sql(_GRID, "SELECT video_id, k, at_ms FROM gr"),
    "q_nearest_frame": _sql(_GRID, "SELECT video_id, k, at_ms, det_id, gap_ms FROM (SELECT gr.*, s.det_id, abs(s.timestamp_ms - gr.at_ms) AS gap_ms, row_number() OVER (PARTITION BY gr.video_id, k ORDER BY abs(s.timestamp_ms - gr.at_ms), s.det_id) AS r FROM gr JOIN s USING (video_id)) WHERE r = 1"),
    "q_sampling_class": _sql(CHANGES, "SELECT frame_index, round(delta, 6) AS delta, CASE WHEN delta < 0.04 THEN 1000 WHEN delta > 0.18 THEN 200 ELSE 333 END AS interval_ms FROM ru"),
    "q_static_carry": _sql(CHANGES, "SELECT frame_index, is_static, max(CASE WHEN NOT is_static THEN frame_index END) OVER (ORDER BY frame_index) AS source_frame FROM (SELECT frame_index, delta < 0.035 AND cut IS NULL AND p_frame_index IS NOT NULL AS is_static FROM ru)"),
    "q_hist_chi2": _sql(CHANGES, "SELECT frame_index, round(chi2, 6) AS chi2 FROM ru"),
    "q_hist_intersection": _sql(CHANGES, "SELECT frame_index, round(overlap, 6) AS overlap FROM ru"),
    "q_ssim": _sql(CHANGES, "SELECT frame_index, round(ssim, 6) AS ssim, round(edge_change, 6) AS edge_change FROM ru"),
    "q_epoch": _sql(CHANGES, "SELECT frame_index, sum(CASE WHEN cut IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY frame_index)::BIGINT AS epoch FROM ru"),
    "q_cut_rule": _sql(CHANGES, "SELECT frame_index, cut FROM ru WHERE cut IS NOT NULL"),
    "q_transition_rule": _sql(CHANGES, """, t AS (SELECT frame_index, lap, p_lap, overlap, lap / (lap + 60.0) AS hf FROM ru WHERE overlap IS NOT NULL)
        SELECT frame_index, CASE WHEN hf < 0.08 AND overlap < 0.55 THEN 'WHIP_PAN' WHEN lap < 45 AND hf < 0.12 THEN 'MOTION_BLUR' ELSE 'DISSOLVE' END AS kind,
        round(CASE WHEN hf < 0.08 AND overlap < 0.55 THEN 1 - hf / 0.08 WHEN lap < 45 AND hf < 0.12 THEN 1 - lap / 45.0 ELSE 0.75 END, 6) AS severity
        FROM t WHERE (hf < 0.08 AND overlap < 0.55) OR (lap < 45 AND hf < 0.12) OR (overlap BETWEEN 0.50 AND 0.72 AND abs(lap - p_lap) > 30)"""),
    "q_cuts_suppressed": _sql(CHANGES + "hit AS (SELECT frame_index AS f FROM ru WHERE cut IS NOT NULL AND frame_index >= 6), acc AS (SELECT min(f) AS f FROM hit UNION ALL SELECT (SELECT min(h.f) FROM hit h WHERE h.f >= acc.f + 6) AS f FROM acc WHERE acc.f IS NOT NULL), ", "SELECT f AS frame_index FROM acc WHERE f IS NOT NULL"),
    "q_scenes": _sql(CHANGES + "hit AS (SELECT frame_index AS f FROM ru WHERE cut IS NOT NULL AND frame_index >= 6), acc AS (SELECT min(f) AS f FROM hit UNION ALL SELECT (SELECT min(h.f) FROM hit h WHERE h.f >= acc.f + 6) AS f FROM acc WHERE acc.f IS NOT NULL), tot AS (SELECT max(frame_index) + 1 AS total FROM fr), b AS (SELECT 0::BIGINT AS start UNION SELECT f::BIGINT FROM acc WHERE f IS NOT NULL), ", "SELECT row_number() OVER (ORDER BY start)::INT AS scene_id, start, coalesce(lead(start) OVER (ORDER BY start), total) AS \"end\", CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence FROM b, tot WHERE start < total OR start = 0"),
    "q_face_scores": _sql(DETECTIONS, "SELECT det_id, round(sq, 6) AS sharpness_quality, round(frontality, 6) AS frontality, round(eyes, 6) AS eyes_open, round(rq, 6) AS recognition_quality, round(rep, 6) AS rep_score, visible, portrait AS solo_portrait FROM s"),
    "q_serfiq_fast": _sql(DETECTIONS, "SELECT det_id, round(least(1.0, greatest(0.0, 0.35 * sq + 0.30 * greatest(0.0, least(1.0, 1 - (0.5 * abs(yaw) / 45.0::DOUBLE + 0.3 * 0 / 35.0::DOUBLE + 0.2 * abs(roll) / 30.0::DOUBLE))) + 0.20 * 1.0 + 0.15 * (CASE WHEN l >= 16.2 AND t >= 28.8 AND l + 120 <= 1063.8 AND t + 160 <= 1891.2 THEN 0.6 ELSE 0.1 END + 0.4 * 0.8))), 6) AS quality FROM s"),
    "q_serfiq_full": _sql(DETECTIONS, "SELECT det_id, round(least(1.0, greatest(0.0, (0.35 * greatest(0.0, least(1.0, (smile - 0.4) / 0.6)) + 0.30 * sq + 0.20 * greatest(0.0, least(1.0, 1 - (0.5 * abs(yaw) / 45.0::DOUBLE + 0.2 * abs(roll) / 30.0::DOUBLE))) + 0.15 * 1.0) * (CASE WHEN l >= 16.2 AND t >= 28.8 AND l + 120 <= 1063.8 AND t + 160 <= 1891.2 THEN 0.6 ELSE 0.1 END + 0.4 * 0.8))), 6) AS quality FROM s"),
    "q_solo_flags": _sql(DETECTIONS, "SELECT det_id, solo, others FROM s"),
    "q_detection_gates": _sql(DETECTIONS, "SELECT det_id FROM s WHERE l < 1080 AND t < 1920 AND 120 >= 0.045 * 1080 AND sharpness >= 25"),
    "q_iou_pairs": _sql(DETECTIONS + PAIRS, "SELECT video_id, frame_index, a, b, round(inter / (2 * 120 * 160 - inter), 6) AS iou, round(inter / (120 * 160), 6) AS over_smaller FROM pr"),
    "q_cannot_link": _sql(DETECTIONS + "ft AS (SELECT video_id, frame_index, person_id, arg_min(l, det_id) AS l, arg_min(t, det_id) AS t FROM s GROUP BY 1, 2, 3), ", f"SELECT DISTINCT a.video_id, a.person_id AS a, b.person_id AS b FROM ft a JOIN ft b ON a.video_id = b.video_id AND a.frame_index = b.frame_index AND a.person_id < b.person_id WHERE ({IOU})::DOUBLE / (2 * 120 * 160 - ({IOU})) < 0.35"),
    "q_match_score": _sql(DETECTIONS + PAIRS, ", x AS (SELECT a, b, inter / (38400 - inter) AS iou, sqrt((al - bl)::DOUBLE ^ 2 + (ta - tb)::DOUBLE ^ 2) / 120.0 AS drift, pa = pb AS same FROM pr) SELECT a, b, round(CASE WHEN iou >= 0.3 OR drift <= 1.1 OR (same AND iou > 0.1) THEN iou + greatest(0.0, least(1.0, 1 - drift / 1.1)) * 0.4 + CASE WHEN same THEN 0.5 ELSE 0.0 END + 0.25 ELSE 0.0 END, 6) AS score FROM x"),
    "q_motion_score": _sql(DETECTIONS + PAIRS, ", x AS (SELECT a, b, inter / (38400 - inter) AS iou, greatest(0.0, least(1.0, 1 - sqrt((al - bl)::DOUBLE ^ 2 + (ta - tb)::DOUBLE ^ 2) / 120.0 / 1.5)) AS motion FROM pr) SELECT a, b, round(motion, 6) AS motion, round(0.25 + 0.3 * iou + 0.2 * motion, 6) AS association FROM x"),
    "q_rank_shots": _sql(DETECTIONS + "p1 AS (SELECT *, max(has_crop::INT) OVER (PARTITION BY person_id) AS any_crop FROM s), p2 AS (SELECT *, max(portrait::INT) OVER (PARTITION BY person_id) AS any_p FROM p1 WHERE has_crop OR any_crop = 0), ", "SELECT person_id, det_id, row_number() OVER (PARTITION BY person_id ORDER BY portrait DESC, clean DESC, visible DESC, (sharpness >= 40) DESC, round(rq, 9) DESC, round(frontality, 9) DESC, round(sharpness, 9) DESC, det_id)::INT AS rank FROM p2 WHERE portrait OR any_p = 0"),
    "q_topn_faces": _sql(DETECTIONS + "p1 AS (SELECT *, max((rq >= 0.55)::INT) OVER (PARTITION BY person_id) AS any_q FROM s), ", "SELECT * FROM (SELECT person_id, det_id, row_number() OVER (PARTITION BY person_id ORDER BY round(rq, 9) DESC, det_id)::INT AS rank FROM p1 WHERE rq >= 0.55 OR any_q = 0) WHERE rank <= 2"),
    "q_best_shot": _sql(DETECTIONS, "SELECT person_id, arg_max(det_id, (round(rep, 9), -det_id)) AS det_id, round(max(rep), 6) AS rep_score FROM s GROUP BY person_id"),
    "q_refine_flags": _sql(DETECTIONS, "SELECT det_id, NOT has_crop OR NOT solo OR NOT clean OR sharpness < 40 AS needs_decode, solo AND clean AND sharpness >= 45 AS acceptable, round(CASE WHEN solo THEN 1000.0 ELSE 0.0 END + CASE WHEN clean THEN 500.0 ELSE 0.0 END + least(sharpness, 45.0), 6) AS fallback_score FROM s"),
    "q_running_best": _sql(DETECTIONS, "SELECT person_id, det_id, round(max(sharpness) OVER (PARTITION BY person_id ORDER BY us, det_id ROWS UNBOUNDED PRECEDING), 6) AS best_so_far FROM s"),
    "q_centroids": _sql(IDENTITIES + WEIGHTED, "SELECT cohort, d::INT AS i, round(w, 4) + 0.0 AS x FROM cen"),
    "q_profiles": _sql(IDENTITIES + WEIGHTED, ", va AS (SELECT cohort, d, avg((x - a) * (x - a)) AS v FROM c JOIN cen USING (cohort, d) GROUP BY cohort, d), ms AS (SELECT cohort, count(*) AS members, avg(q) AS mq, arg_max(vec_id, (q, -vec_id)) AS best FROM i GROUP BY cohort) SELECT cohort, members, round(mq, 6) AS mean_quality, best AS best_id, round(t, 4) AS total_variance FROM ms JOIN (SELECT cohort, sum(v) AS t FROM va GROUP BY cohort) USING (cohort)"),
    "q_profile_similarity": _sql(IDENTITIES + WEIGHTED, ", bs AS (SELECT cohort, arg_max(v, (q, -vec_id)) AS b FROM i GROUP BY cohort), wl AS (SELECT cohort, list(w ORDER BY d) AS w FROM cen GROUP BY cohort), pf AS (SELECT cohort, b, w FROM bs JOIN wl USING (cohort)) SELECT x.cohort AS a, y.cohort AS b, round(0.6 * list_dot_product(x.w, y.w) + 0.2 * list_dot_product(x.b, y.b) + 0.1 * list_dot_product(x.b, y.w) + 0.1 * list_dot_product(y.b, x.w), 6) AS similarity FROM pf x JOIN pf y ON x.cohort < y.cohort"),
    "q_knn": _sql(IDENTITIES + SIMS, "SELECT a AS tracklet_id, b AS neighbour, rank::INT AS rank, round(sim, 6) AS sim FROM kn WHERE rank <= 7"),
    "q_knn_edges": _sql(IDENTITIES + SIMS, "SELECT a AS tracklet_id, b AS neighbour, round(sim, 6) AS sim FROM kn WHERE rank <= 7 AND sim >= 0.35 AND fa <> fb"),
    "q_threshold": _sql(IDENTITIES + SIMS, """, pairs AS (SELECT ca, cb, fa, fb, sim FROM sm WHERE a < b),
        gen AS (SELECT list_sort(list(sim)) AS l FROM pairs WHERE ca = cb AND fa <> fb), imp AS (SELECT list_sort(list(sim)) AS l FROM pairs WHERE fa = fb),
        pc AS (SELECT gen.l[floor((len(gen.l) - 1) * 0.10 + 0.5)::INT + 1] AS g, imp.l[floor((len(imp.l) - 1) * 0.95 + 0.5)::INT + 1] AS i, len(gen.l) AS ng, len(imp.l) AS ni FROM gen, imp)
        SELECT ng AS genuine_n, ni AS impostor_n, round(g, 6) AS genuine_p10, round(i, 6) AS impostor_p95, round(least(0.62, greatest(0.30, CASE WHEN i < g THEN (i + g) / 2 ELSE i + 0.03 END)), 6) AS threshold FROM pc"""),
    "q_linkage": _sql(IDENTITIES, "SELECT x.cohort AS a, y.cohort AS b, round(avg(list_dot_product(x.v, y.v)), 6) AS sim FROM i x JOIN i y ON x.cohort < y.cohort GROUP BY 1, 2"),
    "q_orphan_hosts": _sql(SEGMENTS + TRACKLETS, """, nr AS (SELECT o.video_id, o.id, h.id AS host, row_number() OVER (PARTITION BY o.video_id, o.id ORDER BY h.start_us, h.id) AS r FROM tr o JOIN tr h ON o.video_id = h.video_id AND h.id <> o.id AND h.n_det > 1
        AND abs(o.start_us - h.end_us) <= 3600000000 AND sqrt((h.ll - o.fl)::DOUBLE ^ 2 + (h.lt - o.ft)::DOUBLE ^ 2) / 120.0 <= 1.5 WHERE o.n_det = 1)
        SELECT o.video_id, o.id, coalesce(nr.host, o.id) AS host FROM tr o LEFT JOIN nr ON nr.video_id = o.video_id AND nr.id = o.id AND r = 1 WHERE o.n_det = 1"""),
    "q_captions": _sql(SEGMENTS, "SELECT person_id, 'Person ' || person_id AS label, n || CASE WHEN n = 1 THEN ' appearance' ELSE ' appearances' END AS caption, 'x' || n AS short_caption, lpad(n::VARCHAR, greatest(2, length(n::VARCHAR))::INT, '0') AS padded FROM (SELECT person_id, count(*) AS n FROM g GROUP BY person_id)"),
    "q_run_statistics": _sql(CHANGES, ", x AS (SELECT delta < 0.035 AND cut IS NULL AND p_frame_index IS NOT NULL AS is_static FROM ru) SELECT (SELECT count(*) FROM x) AS frames, (SELECT sum(is_static::INT) FROM x)::BIGINT AS static_frames, count(*) AS detections, count(DISTINCT user_id) AS subjects, round((max(us) - min(us)) / 1e6, 3) AS duration_s FROM ev"),
    "q_collage_layout": _sql(SEGMENTS + TRACKLETS + "ps AS (SELECT video_id, person_id, row_number() OVER (PARTITION BY video_id ORDER BY person_id) - 1 AS slot, count(*) OVER (PARTITION BY video_id) AS n FROM (SELECT DISTINCT video_id, person_id FROM tr)), k0 AS (SELECT *, CASE WHEN n = 1 THEN 1 WHEN n <= 4 THEN 2 WHEN n <= 9 THEN 3 ELSE 4 END AS cols FROM ps), k1 AS (SELECT *, ceil(n / cols::DOUBLE) AS rws, CASE WHEN cols >= 4 THEN 40.0::DOUBLE ELSE 60.0 END AS mg, CASE WHEN cols >= 4 THEN 14.0::DOUBLE ELSE 22.0 END AS gt FROM k0), k2 AS (SELECT *, (1080.0 - mg * 2 - gt * (cols - 1)) / cols AS cw, (1420.0 - gt * (rws - 1)) / rws AS chh FROM k1), k3 AS (SELECT *, least(least(cw, chh * 0.78) / 0.78, chh) AS h FROM k2), k4 AS (SELECT *, least(least(cw, chh * 0.78), h * 0.78) AS w, floor(slot / cols::DOUBLE) AS rw FROM k3), k5 AS (SELECT *, least(cols, n - rw * cols) AS ir FROM k4), ", "SELECT video_id, person_id, slot::INT AS slot, round((1080.0 - (ir * w + gt * (ir - 1))) / 2 + (slot % cols) * (w + gt) + w / 2, 4) AS cx, round(370.0 + (1420.0 - (rws * h + gt * (rws - 1))) / 2 + rw * (h + gt) + h / 2, 4) AS cy, round(w, 4) AS w, round(h, 4) AS h, ([-4.5, 3.8, -2.6, 4.2, -3.4, 2.9, -4.0, 3.2])[slot % 8 + 1]::DOUBLE AS rotation, (slot % 5)::INT AS colour, (slot % 6)::INT AS tape FROM k5"),
}

FACES = (
    EVENTS + ", f0 AS (SELECT event_id AS e, user_id % 10 AS video_id, user_id AS person_id, event_id AS det_id, (us - 1704067200000000) // 3600000000 AS frame_index, us, value * 3.0 AS sharpness, "
    + "(event_id * 37) % 1300 - 150 AS l, (event_id * 53) % 2100 - 150 AS t, 30 + (event_id * 7) % 300 AS w, 40 + (event_id * 11) % 380 AS h FROM ev), f AS (SELECT *, l + w AS r, t + h AS b FROM f0), "
)
_INTER = "(greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.b, b.b) - greatest(a.t, b.t)))::DOUBLE"
FACE_PAIRS = FACES + f"fp AS (SELECT a.det_id AS a, b.det_id AS b, {_INTER} AS inter, (a.w * a.h + b.w * b.h)::DOUBLE - {_INTER} AS uni, least(a.w, b.w)::DOUBLE / greatest(a.w, b.w, 1) AS scale, sqrt(((a.l + a.r - b.l - b.r) / 2.0::DOUBLE) ^ 2 + ((a.t + a.b - b.t - b.b) / 2.0::DOUBLE) ^ 2) / greatest(a.w, b.w, 1) AS drift, a.person_id % 3 = b.person_id % 3 AS same, ((a.det_id + b.det_id) * 41 % 101) / 100.0::DOUBLE AS look FROM f a JOIN f b ON a.video_id = b.video_id AND a.frame_index = b.frame_index AND a.det_id < b.det_id), fq AS (SELECT *, inter / uni AS iou FROM fp), "


def _suppressed(table: str) -> str:
    """nm(video_id, frame_index, det_id, keep): one box of a frame after another, by falling area, against those kept before."""
    box = "{'l': k.l, 't': k.t, 'r': k.r, 'b': k.b}"
    clash = "len(list_filter(nm.kept, lambda y: (greatest(0, least(y.r, k.r) - greatest(y.l, k.l)) * greatest(0, least(y.b, k.b) - greatest(y.t, k.t)))::DOUBLE / least((y.r - y.l) * (y.b - y.t), (k.r - k.l) * (k.b - k.t)) > 0.40)) = 0"
    return (
        f"rk AS (SELECT video_id, frame_index, det_id, l, t, r, b, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY (r - l) * (b - t) DESC, det_id) AS n FROM {table}), "
        f"nm AS (SELECT k.video_id, k.frame_index, k.det_id, k.n, [{box}] AS kept, true AS keep FROM rk k WHERE n = 1 UNION ALL "
        f"SELECT k.video_id, k.frame_index, k.det_id, k.n, CASE WHEN {clash} THEN list_append(nm.kept, {box}) ELSE nm.kept END, {clash} FROM nm JOIN rk k ON k.video_id = nm.video_id AND k.frame_index = nm.frame_index AND k.n = nm.n + 1), "
    )


_MEETS = "c.cl < o.r AND o.l < c.cr AND c.ct < o.b AND o.t < c.cb"
_hold = lambda l, t, r, b: f"CASE WHEN {r} > {l} AND {b} > {t} AND {l} <= c.gl AND {t} <= c.gt AND {r} >= c.gr AND {b} >= c.gb THEN ({r} - {l}) * ({b} - {t}) ELSE -1 END"  # noqa: E731, E741
_PLAN = (
    FACES + "q0 AS (SELECT *, floor(0.18 * w + 0.5)::BIGINT AS dx, floor(0.18 * h + 0.5)::BIGINT AS dy, (l + r) / 2.0::DOUBLE AS cx, (t + b) / 2.0::DOUBLE AS cy, least(2.6::DOUBLE * w, 1080) AS cw FROM f), "
    + "q1 AS (SELECT *, cw / 0.8::DOUBLE AS ch, greatest(0, l - dx) AS gl, greatest(0, t - dy) AS gt, least(1080, r + dx) AS gr, least(1920, b + dy) AS gb FROM q0), "
    + "q2 AS (SELECT *, floor(cw + 0.5)::BIGINT AS iw, floor(ch + 0.5)::BIGINT AS ih FROM q1), "
    + "q3 AS (SELECT *, least(greatest(floor(cx - cw / 2 + 0.5)::BIGINT, 0), greatest(0, 1080 - iw)) AS cl, least(greatest(floor(cy - 0.42::DOUBLE * ch + 0.5)::BIGINT, 0), greatest(0, 1920 - ih)) AS ct FROM q2), "
    + "ot AS (SELECT x.video_id, x.frame_index, x.det_id, y.l, y.t, y.r, y.b, row_number() OVER (PARTITION BY x.video_id, x.frame_index, x.det_id ORDER BY (y.r - y.l) * (y.b - y.t) DESC, y.det_id) AS ka, row_number() OVER (PARTITION BY x.video_id, x.frame_index, x.det_id ORDER BY y.det_id) AS kb FROM f x JOIN f y ON x.video_id = y.video_id AND x.frame_index = y.frame_index AND (x.l, x.t, x.r, x.b) <> (y.l, y.t, y.r, y.b)), "
    + "c1 AS (SELECT video_id, frame_index, det_id, 0::BIGINT AS k, gl, gt, gr, gb, cl, ct, cl + iw AS cr, ct + ih AS cb FROM q3 UNION ALL SELECT video_id, frame_index, det_id, k, gl, gt, gr, gb, "
    + "CASE WHEN m >= 0 AND a1 <> m AND a2 = m THEN nr ELSE cl END, CASE WHEN m >= 0 AND a1 <> m AND a2 <> m AND a3 <> m THEN nb ELSE ct END, CASE WHEN m >= 0 AND a1 = m THEN nl ELSE cr END, CASE WHEN m >= 0 AND a1 <> m AND a2 <> m AND a3 = m THEN nt ELSE cb END "
    + "FROM (SELECT *, CASE WHEN meets THEN greatest(a1, a2, a3, a4) ELSE -1 END AS m FROM (SELECT c.video_id, c.frame_index, c.det_id, o.ka AS k, c.gl, c.gt, c.gr, c.gb, c.cl, c.ct, c.cr, c.cb, o.l AS nl, o.t AS nt, o.r AS nr, o.b AS nb, "
    + f"{_MEETS} AS meets, {_hold('c.cl', 'c.ct', 'o.l', 'c.cb')} AS a1, {_hold('o.r', 'c.ct', 'c.cr', 'c.cb')} AS a2, {_hold('c.cl', 'c.ct', 'c.cr', 'o.t')} AS a3, {_hold('c.cl', 'o.b', 'c.cr', 'c.cb')} AS a4 "
    + "FROM c1 c JOIN ot o ON o.video_id = c.video_id AND o.frame_index = c.frame_index AND o.det_id = c.det_id AND o.ka = c.k + 1))), "
    + "e1 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY video_id, frame_index, det_id ORDER BY k DESC) = 1), "
    + "c2 AS (SELECT e1.video_id, e1.frame_index, e1.det_id, 0::BIGINT AS k, e1.gl, e1.gr, q3.cx, e1.cl, e1.ct, e1.cr, e1.cb FROM e1 JOIN q3 USING (video_id, frame_index, det_id) UNION ALL "
    + f"SELECT c.video_id, c.frame_index, c.det_id, o.kb, c.gl, c.gr, c.cx, CASE WHEN {_MEETS} AND (o.l + o.r) / 2.0::DOUBLE < c.cx AND o.r <= c.gl THEN greatest(c.cl, o.r) ELSE c.cl END, c.ct, "
    + f"CASE WHEN {_MEETS} AND (o.l + o.r) / 2.0::DOUBLE >= c.cx AND o.l >= c.gr THEN least(c.cr, o.l) ELSE c.cr END, c.cb FROM c2 c JOIN ot o ON o.video_id = c.video_id AND o.frame_index = c.frame_index AND o.det_id = c.det_id AND o.kb = c.k + 1), "
    + "e2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY video_id, frame_index, det_id ORDER BY k DESC) = 1), "
    + "e3 AS (SELECT e2.video_id, e2.frame_index, e2.det_id, q3.l, q3.r, q3.h, e2.cx, greatest(0, cl) AS cl0, greatest(0, e2.ct) AS ct, least(1080, cr) AS cr0, least(1920, cb) AS cb FROM (SELECT * EXCLUDE (gl, gr) FROM e2) e2 JOIN (SELECT video_id, frame_index, det_id, l, r, h FROM q3) q3 USING (video_id, frame_index, det_id)), "
    + "e4 AS (SELECT *, cx < 540 AND (r <= 540 OR cx < 0.85::DOUBLE * 540) AS lefty, cx > 540 AND (l >= 540 OR cx > 1.15::DOUBLE * 540) AS righty FROM e3), "
    + "c AS (SELECT video_id, frame_index, det_id, h, CASE WHEN NOT lefty AND righty AND greatest(cl0, 540) < r THEN greatest(cl0, 540) ELSE cl0 END AS cl, ct, CASE WHEN lefty AND least(cr0, 540) > l THEN least(cr0, 540) ELSE cr0 END AS cr, cb FROM e4), "
    + f"cr AS (SELECT c.video_id, c.frame_index, c.det_id, bool_or({_MEETS}) AS hit FROM c JOIN ot o USING (video_id, frame_index, det_id) GROUP BY 1, 2, 3), "
)

PIXELS = "px AS (SELECT vec_id, label::BIGINT AS video_id, i, i % 8 AS x, i // 8 AS y, floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, embedding[i + 1]::DOUBLE + 0.5::DOUBLE)) * 255)::INT AS r, floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, embedding[(i * 7 + 3) % 64 + 1]::DOUBLE + 0.5::DOUBLE)) * 255)::INT AS g, floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, embedding[(i * 5 + 1) % 64 + 1]::DOUBLE + 0.5::DOUBLE)) * 255)::INT AS b FROM (SELECT vec_id, label, embedding, unnest(range(64)) AS i FROM embeddings)), ly AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS v FROM px), "
_NEAR = "nb AS (SELECT vec_id, x, y, v, " + ", ".join(f"lag(v, {k}) OVER w AS m{k}, lead(v, {k}) OVER w AS p{k}" for k in (1, 7, 8, 9)) + " FROM ly WINDOW w AS (PARTITION BY vec_id ORDER BY i)), "
_HSV = "hs AS (SELECT vec_id, greatest(r, g, b) / 255.0::DOUBLE AS hi, (greatest(r, g, b) - least(r, g, b)) / 255.0::DOUBLE AS d, r / 255.0::DOUBLE AS rr, g / 255.0::DOUBLE AS gg, b / 255.0::DOUBLE AS bb FROM px), h1 AS (SELECT vec_id, hi, d, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN hi = rr THEN (gg - bb) / d + CASE WHEN gg < bb THEN 6 ELSE 0 END WHEN hi = gg THEN (bb - rr) / d + 2 ELSE (rr - gg) / d + 4 END AS h6 FROM hs), "

ORACLE |= {
    "q_nms": _sql(DETECTIONS + "bx AS (SELECT video_id, frame_index, det_id, l, t, l + 120 AS r, t + 160 AS b FROM s), " + _suppressed("bx"), "SELECT video_id, frame_index, det_id FROM nm WHERE keep"),
    "q_face_nms": _sql(FACES + _suppressed("f"), "SELECT video_id, frame_index, det_id FROM nm WHERE keep"),
    "q_kalman": _sql(DETECTIONS + """o AS (SELECT video_id, person_id, det_id, l + 60.0::DOUBLE AS mx, t + 80.0::DOUBLE AS my, row_number() OVER (PARTITION BY video_id, person_id ORDER BY us, det_id) AS n FROM s),
        kf AS (SELECT video_id, person_id, det_id, n, mx AS ox, my AS oy, mx AS x, 0.0::DOUBLE AS vx, my AS y, 0.0::DOUBLE AS vy, 10.0::DOUBLE AS p, 100.0::DOUBLE AS pv FROM o WHERE n = 1
        UNION ALL SELECT video_id, person_id, det_id, n, px, py, x, vx + 0.5 * g * (mx - x), y, vy + 0.5 * g * (my - y), p * (1 - g), pv FROM (SELECT *, px + g * (mx - px) AS x, py + g * (my - py) AS y FROM
        (SELECT o.video_id, o.person_id, o.det_id, o.n, o.mx, o.my, k.x + k.vx AS px, k.y + k.vy AS py, k.vx, k.vy, k.p + (1.0 + k.pv) AS p, k.pv + 0.01::DOUBLE AS pv, (k.p + (1.0 + k.pv)) / (k.p + (1.0 + k.pv) + 1.0) AS g
        FROM kf k JOIN o ON o.video_id = k.video_id AND o.person_id = k.person_id AND o.n = k.n + 1))), """, "SELECT video_id, person_id, det_id, round(ox, 4) AS predicted_x, round(oy, 4) AS predicted_y FROM kf"),
    "q_crop_plan": _sql(_PLAN, 'SELECT video_id, frame_index, det_id, cl::INT AS "left", ct::INT AS top, c.cr::INT AS "right", cb::INT AS bottom, NOT coalesce(hit, false) AS is_clean, CASE WHEN cb > ct THEN round(h::DOUBLE / (cb - ct), 6) ELSE 1.0 END AS coverage FROM c LEFT JOIN cr USING (video_id, frame_index, det_id)'),
    "q_face_gates": _sql(FACES, "SELECT det_id, count(*) OVER (PARTITION BY video_id, frame_index) AS on_screen, w >= 0.045 * 1080 AS wide, sharpness >= 25 AS sharp, l >= 0 AND t >= 0 AND r <= 1080 AND b <= 1920 AS inside FROM f WHERE l < 1080 AND r > 0 AND t < 1920 AND b > 0"),
    "q_face_quality": _sql(FACES, "SELECT det_id, round(least(1.0, greatest(0.0, 0.35 * sharpness / (sharpness + 150.0) + 0.30 * greatest(0.0, least(1.0, 1 - (0.5 * abs((e * 13) % 121 - 60) / 45.0::DOUBLE + 0.3 * abs((e * 31) % 91 - 45) / 35.0::DOUBLE + 0.2 * abs((e * 17) % 81 - 40) / 30.0::DOUBLE))) + 0.20 * least(1.0, least(w, h) / 112.0::DOUBLE) + 0.15 * (CASE WHEN l >= 16.2 AND t >= 28.8 AND r <= 1063.8 AND b <= 1891.2 THEN 0.6 ELSE 0.1 END + 0.4 * (e % 6) / 5.0::DOUBLE))), 6) AS quality FROM f"),
    "q_face_pairs": _sql(FACE_PAIRS, "SELECT a, b, round(CASE WHEN scale >= 0.55 AND (iou >= 0.3 OR drift <= 1.1 OR (same AND iou > 0.1)) AND look >= 0.25 THEN iou + 0.4 * greatest(0.0, least(1.0, 1 - drift / 1.1)) + CASE WHEN same THEN 0.5 ELSE 0.0 END + 0.25 * look ELSE 0.0 END, 6) AS score, round(0.5 * look + 0.3 * iou + 0.2 * greatest(0.0, least(1.0, 1 - drift / 1.5)), 6) AS association FROM fq"),
    "q_scaled_boxes": _sql(FACES + "sc AS (SELECT *, 0.5::DOUBLE + (e % 7) / 4.0::DOUBLE AS s FROM f), ", 'SELECT det_id, least(greatest(trunc(l * s)::INT, 0), 1080)::INT AS "left", least(greatest(trunc(t * s)::INT, 0), 1920)::INT AS top, least(greatest(trunc(r * s)::INT, 0), 1080)::INT AS "right", least(greatest(trunc(b * s)::INT, 0), 1920)::INT AS bottom FROM sc'),
    "q_fill_crops": _sql(FACES + "z AS (SELECT det_id, w::DOUBLE AS w, h::DOUBLE AS h, CASE WHEN w::DOUBLE / h > 0.75 THEN h * 0.75::DOUBLE ELSE w END AS cw, CASE WHEN w::DOUBLE / h > 0.75 THEN h ELSE w / 0.75::DOUBLE END AS ch FROM f), ", 'SELECT det_id, round((w - cw) / 2, 6) AS "left", round((h - ch) * 0.35, 6) AS top, round((w + cw) / 2, 6) AS "right", round((h - ch) * 0.35 + ch, 6) AS bottom FROM z'),
    "q_roll": _sql(FACES + "z AS (SELECT det_id, degrees(atan2(((e * 7) % 120 - (e * 11) % 100)::DOUBLE, ((e * 3) % 200 - (e * 5) % 90)::DOUBLE)) AS a FROM f), ", "SELECT det_id, CASE WHEN abs(a) <= 35 THEN round(a, 6) ELSE 0.0 END AS roll FROM z"),
    "q_frame_sizes": _sql(FACES + "z AS (SELECT det_id, e % 4 IN (1, 3) AS turned, CASE WHEN e % 11 <> 0 THEN 320 + e % 1700 ELSE 1080 END AS w0, CASE WHEN e % 13 <> 0 THEN 240 + (e * 3) % 2300 ELSE 1920 END AS h0 FROM f), z1 AS (SELECT det_id, CASE WHEN turned THEN h0 ELSE w0 END AS dw, CASE WHEN turned THEN w0 ELSE h0 END AS dh FROM z), z2 AS (SELECT *, least(1.0::DOUBLE, 480.0::DOUBLE / greatest(dw, dh)) AS s FROM z1), ", "SELECT det_id, dw::INT AS display_width, dh::INT AS display_height, greatest(16, (floor(dw * s / 2) * 2)::INT)::INT AS width, greatest(16, (floor(dh * s / 2) * 2)::INT)::INT AS height FROM z2"),
    "q_best_overlap": _sql(FACES + "mv AS (SELECT video_id, frame_index, det_id + 1000000000 AS det_id, l + e % 5 * 15 AS l, t + e % 3 * 20 AS t, r + e % 7 * 12 AS r, b + e % 4 * 10 AS b FROM f), " + f"pr AS (SELECT a.det_id, b.det_id AS match, {_INTER} AS inter, ((a.r - a.l) * (a.b - a.t) + (b.r - b.l) * (b.b - b.t))::DOUBLE - {_INTER} AS uni FROM f a JOIN mv b USING (video_id, frame_index)), ", "SELECT det_id, match, round(inter / uni, 6) AS iou FROM pr WHERE inter / uni >= 0.3 QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY inter / uni DESC, match) = 1"),
    "q_refine_pick": _sql(DETECTIONS + """p1 AS (SELECT *, max(has_crop::INT) OVER (PARTITION BY person_id) AS any_crop FROM s), p2 AS (SELECT *, max(portrait::INT) OVER (PARTITION BY person_id) AS any_p FROM p1 WHERE has_crop OR any_crop = 0),
        rk AS (SELECT person_id, det_id, row_number() OVER (PARTITION BY person_id ORDER BY portrait DESC, clean DESC, visible DESC, (sharpness >= 40) DESC, round(rq, 9) DESC, round(frontality, 9) DESC, round(sharpness, 9) DESC, det_id) AS rank, NOT has_crop OR NOT solo OR NOT clean OR sharpness < 40 AS needs FROM p2 WHERE portrait OR any_p = 0),
        sk AS (SELECT *, det_id % 9 <> 0 AS seen, det_id % 4 <> 0 AS c2, det_id % 3 = 0 AS s2, (det_id * 43 % 100)::DOUBLE AS h2 FROM rk),
        sc AS (SELECT *, seen AND c2 AND s2 AND h2 >= 45 AS good, CASE WHEN c2 THEN 1000 ELSE 0 END + CASE WHEN s2 THEN 500 ELSE 0 END + least(h2, 45) AS score FROM sk WHERE rank <= 3),
        ag AS (SELECT person_id, arg_min(det_id, rank) AS first, arg_min(needs, rank) AS needs, arg_min(det_id, rank) FILTER (good) AS good, arg_max(det_id, (score, -rank)) FILTER (seen) AS fallback FROM sc GROUP BY person_id), """,
        "SELECT person_id, CASE WHEN NOT needs THEN first ELSE coalesce(good, fallback, first) END AS det_id, CASE WHEN NOT needs THEN 'existing' WHEN good IS NOT NULL THEN 'verified' WHEN fallback IS NOT NULL THEN 'fallback' ELSE 'unverified' END AS source FROM ag"),
    "q_planned_inferences": _sql(DETECTIONS + "p1 AS (SELECT *, max((rq >= 0.55)::INT) OVER (PARTITION BY person_id) AS any_q FROM s), p2 AS (SELECT person_id, least(2, count(*)) AS n FROM p1 WHERE rq >= 0.55 OR any_q = 0 GROUP BY person_id), ", "SELECT count(*) AS tracks, sum(n)::BIGINT AS inferences FROM p2"),
    "q_usable": _sql(DETECTIONS, "SELECT det_id, round(rq, 6) AS recognition_quality FROM s WHERE rq >= 0.5 AND person_id % 3 <> 0 AND person_id IN (SELECT vec_id FROM embeddings)"),
    "q_strongest": _sql(IDENTITIES + SIMS, "SELECT a AS tracklet_id, b AS neighbour, rank::INT AS rank FROM kn WHERE rank <= 3"),
    "q_outcomes": _sql(EVENTS + ", v AS (SELECT unnest(range(14)) AS video_id), d AS (SELECT user_id % 10 AS video_id, count(*) AS n, count(DISTINCT user_id) AS u FROM ev GROUP BY 1), ", "SELECT v.video_id, coalesce(n, 0)::BIGINT AS detections, coalesce(u, 0)::BIGINT AS subjects, CASE WHEN n IS NULL THEN 'no_faces' ELSE 'ok' END AS status FROM v LEFT JOIN d USING (video_id)"),
    "q_ordered_timeline": _sql(SEGMENTS, "SELECT person_id % 10 AS video_id, (row_number() OVER (PARTITION BY person_id % 10 ORDER BY start_us, person_id, idx) - 1)::INT AS position, person_id, idx AS index FROM g"),
    "q_carried_faces": _sql(CHANGES + "st AS (SELECT frame_index, delta < 0.035 AND cut IS NULL AND p_frame_index IS NOT NULL AS is_static FROM ru), sr AS (SELECT frame_index, max(CASE WHEN NOT is_static THEN frame_index END) OVER (ORDER BY frame_index) AS src FROM st), de AS (SELECT (us - 1704067200000000) // 3600000000 AS src, event_id AS det_id FROM ev), ", "SELECT frame_index, det_id, src <> frame_index AS carried FROM sr JOIN de USING (src)"),
    "q_recent": _sql(DETECTIONS, "SELECT person_id, det_id, (count(*) OVER w)::INT AS n, round(sum(sharpness) OVER w, 6) AS sum FROM s WINDOW w AS (PARTITION BY person_id ORDER BY us, det_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"),
    "q_image_measures": _sql(PIXELS + _NEAR + "ins AS (SELECT vec_id, 4 * v - m1 - p1 - m8 - p8 AS lap, sqrt(((m7 + 2 * p1 + p9 - m9 - 2 * m1 - p7) / 255) ^ 2 + ((p7 + 2 * p8 + p9 - m9 - 2 * m8 - m7) / 255) ^ 2) AS sob FROM nb WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6), mi AS (SELECT vec_id, var_pop(lap) AS lv, avg(sob) AS ed FROM ins GROUP BY 1), mb AS (SELECT vec_id, avg(v) / 255 AS br FROM ly GROUP BY 1), ", "SELECT vec_id AS frame_index, round(br, 6) AS brightness, round(lv, 4) AS lap_var, round(ed, 6) AS edge FROM mi JOIN mb USING (vec_id)"),
    "q_image_histograms": _sql(PIXELS + _HSV + "bn AS (SELECT vec_id, 'luma_hist' AS kind, trunc(v / 256 * 31.99::DOUBLE)::INT AS bin FROM ly UNION ALL SELECT vec_id, 'hsv_hist', (trunc(h6 * 60 / 360 * 15.99::DOUBLE)::INT * 4 + trunc(CASE WHEN hi > 0 THEN d / hi ELSE 0 END * 3.99::DOUBLE)::INT) * 4 + trunc(hi * 3.99::DOUBLE)::INT FROM h1), ", "SELECT vec_id AS frame_index, kind, bin::INT AS bin, round(count(*) / 64.0::DOUBLE, 6) AS share FROM bn GROUP BY 1, 2, 3"),
    "q_luma_delta": _sql(PIXELS + "fr AS (SELECT vec_id, lag(vec_id) OVER (PARTITION BY video_id ORDER BY vec_id) AS p FROM (SELECT DISTINCT vec_id, video_id FROM px)), dl AS (SELECT fr.vec_id, avg(abs(a.v - b.v)) / 255 AS d FROM fr JOIN ly a ON a.vec_id = fr.vec_id JOIN ly b ON b.vec_id = fr.p AND b.i = a.i GROUP BY 1), ", "SELECT DISTINCT px.video_id, px.vec_id AS frame_index, coalesce(round(d, 4), 1.0) AS delta FROM px LEFT JOIN dl USING (vec_id)"),
    "q_cell_embedding": _sql(PIXELS + "bl AS (SELECT *, lag(b, 1) OVER w AS lb, lag(b, 8) OVER w AS tb FROM ly WINDOW w AS (PARTITION BY vec_id ORDER BY i)), mo AS (SELECT vec_id, i, unnest([r / 255.0::DOUBLE, g / 255.0::DOUBLE, b / 255.0::DOUBLE, v / 255.0::DOUBLE, CASE WHEN x > 0 AND y > 0 THEN abs(v - lb) + abs(v - tb) ELSE 0.0 END / 255.0::DOUBLE, (r - b) / 255.0::DOUBLE, (g - r) / 255.0::DOUBLE, v / (r + 1.0::DOUBLE)]) AS m, unnest(range(8)) AS k FROM bl), nm AS (SELECT vec_id, greatest(1e-8, sqrt(sum(m * m))) AS n FROM mo GROUP BY 1), ", "SELECT vec_id AS frame_index, (i * 8 + k)::INT AS i, round(m / n, 5) + 0.0 AS x FROM mo JOIN nm USING (vec_id)"),
}

# ---- order-dependent operators as recursions: one node, merge, tracklet or pick after another

_NODES = IDENTITIES + "nd AS (SELECT cohort, vec_id, v, q, co, row_number() OVER (PARTITION BY cohort ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY cohort) AS n FROM i), "
_NEAR_NODES = _NODES + "ns AS (SELECT a.cohort, a.k AS a, b.k AS b, a.co = b.co AND a.k <> b.k AS foe, a.q AS qa, b.q AS qb, round(least(1.0, greatest(-1.0, list_dot_product(a.v, b.v))), 12) AS sim FROM nd a JOIN nd b USING (cohort)), "
_LABELS = _NEAR_NODES + """ed AS (SELECT cohort, a, b, sim, r FROM (SELECT *, row_number() OVER (PARTITION BY cohort, a ORDER BY sim DESC, b) AS r FROM ns) WHERE r <= 8 AND a <> b AND sim >= 0.35 AND NOT foe),
 en AS (SELECT cohort, a, list(b ORDER BY r) AS bs, list(sim ORDER BY r) AS ss FROM ed GROUP BY cohort, a),
 fn AS (SELECT cohort, a, list(b) AS fs FROM ns WHERE foe GROUP BY cohort, a),
 st AS (SELECT nd.cohort, nd.k, nd.n, en.bs, en.ss, coalesce(fn.fs, []) AS fs FROM nd LEFT JOIN en ON en.cohort = nd.cohort AND en.a = nd.k LEFT JOIN fn ON fn.cohort = nd.cohort AND fn.a = nd.k),
 lp AS (SELECT cohort, 0::BIGINT AS step, list(vec_id ORDER BY k) AS lab FROM nd GROUP BY cohort
   UNION ALL SELECT cohort, step + 1, CASE WHEN len(vote) = 0 THEN lab ELSE list_concat(list_concat(lab[:k - 1], [list_reverse_sort(vote)[1].l]), lab[k + 1:]) END
   FROM (SELECT cohort, step, k, lab, list_transform(list_distinct(ok), lambda l: {'s': list_sum(list_transform(list_filter(range(1, len(bs) + 1), lambda j: lab[bs[j]] = l), lambda j: ss[j])), 'f': -list_position(list_transform(bs, lambda j: lab[j]), l), 'l': l}) AS vote
     FROM (SELECT lp.cohort, lp.step, st.k, lp.lab, coalesce(st.bs, []) AS bs, coalesce(st.ss, []) AS ss, list_filter(list_transform(coalesce(st.bs, []), lambda j: lp.lab[j]), lambda l: NOT list_contains(list_transform(st.fs, lambda j: lp.lab[j]), l)) AS ok
       FROM lp JOIN st ON st.cohort = lp.cohort AND st.k = lp.step % st.n + 1 WHERE lp.step < 15 * st.n))),
 fl AS (SELECT cohort, unnest(lab) AS l, unnest(range(1, len(lab) + 1)) AS k FROM lp QUALIFY step = max(step) OVER (PARTITION BY cohort)),
 gp AS (SELECT cohort, l, row_number() OVER (PARTITION BY cohort ORDER BY count(*) DESC, min(k)) AS person FROM fl GROUP BY cohort, l), """
_MERGED = _NEAR_NODES + """im AS (SELECT cohort, list_sort(list(sim)) AS l FROM ns WHERE foe AND a < b GROUP BY cohort),
 th AS (SELECT cohort, least(0.62, greatest(0.30, CASE WHEN len(l) >= 5 THEN l[floor((len(l) - 1) * 0.95 + 0.5)::INT + 1] + 0.06 ELSE 0.45 END)) AS t FROM (SELECT DISTINCT cohort FROM nd) LEFT JOIN im USING (cohort)),
 pl AS (SELECT cohort, list({'a': a, 'b': b, 's': sim, 'foe': foe, 'q': least(qa, qb)} ORDER BY a, b) AS ps, any_value(n) AS n FROM ns JOIN (SELECT DISTINCT cohort, n FROM nd) USING (cohort) WHERE a < b GROUP BY cohort),
 ag AS (SELECT cohort, 0::BIGINT AS step, list(k ORDER BY k) AS lab FROM nd GROUP BY cohort
   UNION ALL SELECT cohort, step + 1, list_transform(lab, lambda g: CASE WHEN g = y THEN x ELSE g END)
   FROM (SELECT c.cohort, c.step, c.lab, c.x, c.y, row_number() OVER (PARTITION BY c.cohort ORDER BY c.s DESC, c.x, c.y) AS best, c.s, c.q FROM
     (SELECT cohort, step, any_value(lab) AS lab, least(ga, gb) AS x, greatest(ga, gb) AS y, avg(s) AS s, bool_or(foe) AS foe, min(q) AS q FROM
       (SELECT ag.cohort, ag.step, ag.lab, ag.lab[p.a] AS ga, ag.lab[p.b] AS gb, p.s, p.foe, p.q FROM ag JOIN pl USING (cohort), unnest(pl.ps) AS u(p)) WHERE ga <> gb GROUP BY cohort, step, least(ga, gb), greatest(ga, gb)) c WHERE NOT c.foe) b JOIN th USING (cohort) WHERE best = 1 AND s > -1 AND s >= t + (1 - q) * 0.03),
 fl AS (SELECT cohort, unnest(lab) AS l, unnest(range(1, len(lab) + 1)) AS k FROM ag QUALIFY step = max(step) OVER (PARTITION BY cohort)),
 gp AS (SELECT cohort, l, row_number() OVER (PARTITION BY cohort ORDER BY count(*) DESC, min(k)) AS person FROM fl GROUP BY cohort, l), """
_REGISTERED = _NODES + """un AS (SELECT *, list_transform(v, lambda x: x / greatest(1e-8, sqrt(list_dot_product(v, v)))) AS u FROM nd),
 rg AS (SELECT cohort, 0::BIGINT AS step, n, []::STRUCT(w DOUBLE[], b DOUBLE[], qm DOUBLE, fr BIGINT[])[] AS ps, 0::BIGINT AS person FROM (SELECT DISTINCT cohort, n FROM nd)
  UNION ALL SELECT cohort, step + 1, n, CASE WHEN pick IS NULL THEN list_append(ps, {'w': u, 'b': v, 'qm': q, 'fr': [co]})
     ELSE list_concat(list_append(ps[:pick - 1], {'w': list_transform(mw, lambda x: x / greatest(1e-8, sqrt(list_dot_product(mw, mw)))), 'b': CASE WHEN ps[pick].qm >= q THEN ps[pick].w ELSE v END, 'qm': ps[pick].qm + q, 'fr': list_append(ps[pick].fr, co)}), ps[pick + 1:]) END,
     coalesce(pick, len(ps) + 1)
  FROM (SELECT *, list_transform(range(1, len(v) + 1), lambda d: coalesce(ps[pick].w[d], 0.0) * greatest(0.05, coalesce(ps[pick].qm, 0.0)) + v[d] * greatest(0.05, q)) AS mw FROM
   (SELECT *, CASE WHEN len(sc) > 0 AND list_reverse_sort(sc)[1].s >= 0.3 THEN list_reverse_sort(sc)[1].j END AS pick FROM
    (SELECT *, list_transform(list_filter(near, lambda x: NOT list_contains(ps[x.j].fr, co)), lambda x: {'s': least(1.0, greatest(-1.0, 0.6 * x.d + 0.2 * list_dot_product(ps[x.j].b, v) + 0.1 * list_dot_product(ps[x.j].b, u) + 0.1 * list_dot_product(v, ps[x.j].w))), 'd': x.d, 'f': x.f, 'j': x.j}) AS sc FROM
     (SELECT r.cohort, r.step, r.n, r.ps, un.v, un.u, un.q, un.co, list_slice(list_reverse_sort(list_transform(range(1, len(r.ps) + 1), lambda j: {'d': list_dot_product(r.ps[j].w, un.u), 'f': -j, 'j': j})), 1, 5) AS near
      FROM rg r JOIN un ON un.cohort = r.cohort AND un.k = r.step + 1))))), """
_FACES_BY_FRAME = DETECTIONS + "ff AS (SELECT video_id, frame_index AS fr, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS fk, list({'d': det_id::BIGINT, 'l': l::DOUBLE, 't': t::DOUBLE} ORDER BY det_id) AS faces FROM s GROUP BY video_id, frame_index), "
_tx, _ty = "tk.tr[a]", "tk.faces[b]"
_t_inter = f"greatest(0.0, 120 - abs({_tx}.x - 60 - {_ty}.l)) * greatest(0.0, 160 - abs({_tx}.y - 80 - {_ty}.t))"
_t_score = f"0.25 + 0.3 * ({_t_inter}) / (38400 - ({_t_inter})) + 0.2 * greatest(0.0, least(1.0, 1 - sqrt(({_tx}.x - 60 - {_ty}.l) ^ 2 + ({_tx}.y - 80 - {_ty}.t) ^ 2) / 120.0 / 1.5))"
_t_state = "{{'id': {id}, 'x': {x}, 'vx': {vx}, 'y': {y}, 'vy': {vy}, 'p': {p}, 'pv': {pv}, 'since': {since}, 'used': {used}}}"
_t_aged = _t_state.format(id="x.id", x="x.x + x.vx", vx="x.vx", y="x.y + x.vy", vy="x.vy", p="x.p + (1.0 + x.pv)", pv="x.pv + 0.01", since="x.since + 1", used="false")
_t_born = _t_state.format(id="nx + k", x="faces[k].l + 60", vx="0.0::DOUBLE", y="faces[k].t + 80", vy="0.0::DOUBLE", p="111.0::DOUBLE", pv="100.01::DOUBLE", since="1", used="false")
_t_hit = _t_state.format(id="o.id", x="nxx", vx="o.vx + 0.5 * g * (f.l + 60 - nxx)", y="nyy", vy="o.vy + 0.5 * g * (f.t + 80 - nyy)", p="o.p * (1 - g)", pv="o.pv", since="0", used="true")
_TRACKS = _FACES_BY_FRAME + f"""al AS (SELECT video_id, unnest(range(min(fr), max(fr) + 1)) AS fr FROM ff GROUP BY video_id), af AS (SELECT al.video_id, al.fr, coalesce(ff.faces, []) AS faces FROM al LEFT JOIN ff ON ff.video_id = al.video_id AND ff.fr = al.fr),
  tk AS (SELECT video_id, fr, faces, []::STRUCT(id BIGINT, x DOUBLE, vx DOUBLE, y DOUBLE, vy DOUBLE, p DOUBLE, pv DOUBLE, since BIGINT, used BOOLEAN)[] AS tr, 0::BIGINT AS nx, []::STRUCT(d BIGINT, id BIGINT)[] AS got FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY fr) AS n FROM af) WHERE n = 1
  UNION ALL SELECT video_id, CASE WHEN i IS NULL THEN fr + 1 ELSE fr END, CASE WHEN i IS NULL THEN nfaces ELSE list_concat(faces[:j - 1], faces[j + 1:]) END,
    CASE WHEN i IS NULL THEN list_concat(list_transform(list_filter(tr, lambda x: x.since <= 4), lambda x: {_t_aged}), list_transform(range(1, len(faces) + 1), lambda k: {_t_born}))
      ELSE list_concat(list_append(tr[:i - 1], {_t_hit}), tr[i + 1:]) END,
    CASE WHEN i IS NULL THEN nx + len(faces) ELSE nx END,
    CASE WHEN i IS NULL THEN list_transform(range(1, len(faces) + 1), lambda k: {{'d': faces[k].d, 'id': nx + k}}) ELSE [{{'d': f.d, 'id': o.id}}] END
  FROM (SELECT *, o.x + g * (f.l + 60 - o.x) AS nxx, o.y + g * (f.t + 80 - o.y) AS nyy FROM (SELECT *, tr[i] AS o, faces[j] AS f, tr[i].p / (tr[i].p + 1.0) AS g FROM
   (SELECT *, -list_reverse_sort(ps)[1].i AS i, -list_reverse_sort(ps)[1].j AS j FROM
    (SELECT tk.*, n.faces AS nfaces, list_filter(flatten(list_transform(range(1, len(tk.tr) + 1), lambda a: list_transform(range(1, len(tk.faces) + 1), lambda b: {{'s': CASE WHEN tk.tr[a].used THEN 0.0 ELSE {_t_score} END, 'i': -a, 'j': -b}}))), lambda x: x.s >= 0.40) AS ps
     FROM tk LEFT JOIN af n ON n.video_id = tk.video_id AND n.fr = tk.fr + 1 WHERE tk.faces IS NOT NULL))))),
  gt AS (SELECT video_id, unnest(got) AS g FROM tk), """
_iw = lambda a, b: f"greatest(0.0, least({a}.l, {b}.l) + 120 - greatest({a}.l, {b}.l)) * greatest(0.0, least({a}.t, {b}.t) + 160 - greatest({a}.t, {b}.t))"
_dr = lambda a, b: f"sqrt(({a}.l - {b}.l) ^ 2 + ({a}.t - {b}.t) ^ 2) / 120.0"
_TRACKLETS = _FACES_BY_FRAME + f"""tk AS (SELECT video_id, 1::BIGINT AS fk, fr, faces, []::STRUCT(id BIGINT, l DOUBLE, t DOUBLE, last BIGINT, used BOOLEAN)[] AS tr, 0::BIGINT AS nx, []::STRUCT(d BIGINT, id BIGINT)[] AS got FROM ff WHERE fk = 1
  UNION ALL SELECT video_id, CASE WHEN i IS NULL THEN fk + 1 ELSE fk END, CASE WHEN i IS NULL THEN nfr ELSE fr END, CASE WHEN i IS NULL THEN nfaces ELSE list_concat(faces[:j - 1], faces[j + 1:]) END,
    CASE WHEN i IS NULL THEN list_concat(list_transform(list_filter(tr, lambda x: x.last >= nfr - 2), lambda x: {{'id': x.id, 'l': x.l, 't': x.t, 'last': x.last, 'used': false}}), CASE WHEN fr >= nfr - 2 THEN list_transform(range(1, len(faces) + 1), lambda k: {{'id': nx + k - 1, 'l': faces[k].l, 't': faces[k].t, 'last': fr, 'used': false}}) ELSE [] END)
      ELSE list_concat(list_append(tr[:i - 1], {{'id': tr[i].id, 'l': faces[j].l, 't': faces[j].t, 'last': fr, 'used': true}}), tr[i + 1:]) END,
    CASE WHEN i IS NULL THEN nx + len(faces) ELSE nx END,
    CASE WHEN i IS NULL THEN list_transform(range(1, len(faces) + 1), lambda k: {{'d': faces[k].d, 'id': nx + k - 1}}) ELSE [{{'d': faces[j].d, 'id': tr[i].id}}] END
  FROM (SELECT *, -list_reverse_sort(ps)[1].i AS i, -list_reverse_sort(ps)[1].j AS j FROM
    (SELECT tk.*, n.fr AS nfr, n.faces AS nfaces, list_filter(flatten(list_transform(range(1, len(tk.tr) + 1), lambda a: list_transform(range(1, len(tk.faces) + 1), lambda b: {{'s': CASE WHEN tk.tr[a].used THEN 0.0 ELSE coalesce((SELECT_SCORE), 0.0) END, 'i': -a, 'j': -b}}))), lambda x: x.s > 0) AS ps
     FROM tk LEFT JOIN ff n ON n.video_id = tk.video_id AND n.fk = tk.fk + 1 WHERE tk.faces IS NOT NULL))),
  gt AS (SELECT video_id, fr, unnest(got) AS g FROM (SELECT video_id, got, lag(fr) OVER () AS fr FROM tk)), """
_g_inter, _g_drift = _iw(_tx, _ty), _dr(_tx, _ty)
_g_score = f"CASE WHEN ({_g_inter}) / (38400 - ({_g_inter})) >= 0.3 OR {_g_drift} <= 1.1 THEN ({_g_inter}) / (38400 - ({_g_inter})) + 0.4 * greatest(0.0, least(1.0, 1 - {_g_drift} / 1.1)) + 0.25 ELSE 0.0 END"
_TRACKLETS = _TRACKLETS.replace('(SELECT_SCORE)', _g_score)
_TRACKLETS = _TRACKLETS.replace("gt AS (SELECT video_id, fr, unnest(got) AS g FROM (SELECT video_id, got, lag(fr) OVER () AS fr FROM tk)), ", "gt AS (SELECT video_id, unnest(got) AS g FROM tk), ga AS (SELECT gt.video_id, g.d AS det_id, g.id AS id, s.frame_index AS fr FROM gt JOIN s ON s.det_id = g.d), gb AS (SELECT video_id, id, min(fr) AS first, max(fr) AS last FROM ga GROUP BY 1, 2), gc AS (SELECT gb.*, (SELECT min(ff.fr) FROM ff WHERE ff.video_id = gb.video_id AND ff.fr > gb.last + 2) AS closed FROM gb), gd AS (SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY first, closed NULLS LAST, id) - 1 AS tracklet_id FROM gc), ")

_PERSONS = "SELECT cohort, vec_id AS tracklet_id, person::INT AS person_id FROM fl JOIN gp USING (cohort, l) JOIN nd USING (cohort, k)"
ORACLE |= {
    "q_label_prop": _sql(_LABELS, _PERSONS),
    "q_agglomerative": _sql(_MERGED, _PERSONS),
    "q_registry": _sql(_REGISTERED, "SELECT rg.cohort, vec_id AS tracklet_id, person::INT AS person_id FROM rg JOIN nd ON nd.cohort = rg.cohort AND nd.k = rg.step"),
    "q_tracks": _sql(_TRACKS, "SELECT video_id, g.d AS det_id, g.id::INT AS track_id FROM gt"),
    "q_tracklets": _sql(_TRACKLETS, "SELECT ga.video_id, ga.det_id, gd.tracklet_id::INT AS tracklet_id FROM ga JOIN gd USING (video_id, id)"),
}
