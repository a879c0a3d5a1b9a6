"""Named building blocks; :func:`with_ctes` adds the ones a statement mentions, in dependency order."""

from __future__ import annotations

import re

from fieldstate import schema as S

CLASS_ROWS = ",".join(
    f"('{category}','{name}',{code})" for category, names in S.CLASSES.items() for code, name in enumerate(names)
)
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
AFTER = "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"

CTES: dict[str, str] = {}

# ---- inputs --------------------------------------------------------------------------------------------
CTES["fx_classes"] = f"SELECT category, class, k AS class_value FROM (VALUES {CLASS_ROWS}) AS t(category, class, k)"
CTES["fx_img"] = """
WITH raw AS (
 SELECT l_suppkey AS site_no,
  DATE '2018-01-01' + CAST((year(l_shipdate) * 365 + dayofyear(l_shipdate)) % 500 AS INT) AS date,
  (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 1000 AS h0
 FROM lineitem),
img AS (SELECT site_no, date, 9 + h0 % 7 AS hour, min(h0) AS h FROM raw GROUP BY site_no, date, 9 + h0 % 7),
ph AS (SELECT *, (dayofyear(date) + 13 * site_no) % 365 AS phase, year(date) AS yr FROM img)
SELECT concat('site', CAST(site_no AS VARCHAR(8))) AS phenocam_name, site_no, date, hour, h, phase,
 concat('site', CAST(site_no AS VARCHAR(8)), '_', CAST(yr AS VARCHAR(4)), '_',
        lpad(CAST(month(date) AS VARCHAR(2)), 2, '0'), '_', lpad(CAST(day(date) AS VARCHAR(2)), 2, '0'), '_',
        lpad(CAST(hour AS VARCHAR(2)), 2, '0'), '0000.jpg') AS file,
 CASE WHEN phase < 60 THEN 4 WHEN phase < 150 THEN 2 WHEN phase < 180 THEN 3 WHEN phase < 330 THEN 1 ELSE 2 END AS dc,
 CASE WHEN phase < 150 THEN 6 WHEN phase < 175 THEN 1 WHEN phase < 230 THEN 2 WHEN phase < 260 THEN 3
      WHEN phase < 300 THEN 4 WHEN phase < 330 THEN 5 ELSE 6 END AS cs,
 CASE WHEN phase < 150 THEN 7 WHEN phase < 190 THEN 1 WHEN phase < 330 THEN CAST(2 + (yr + site_no) % 5 AS INT) ELSE 7 END AS ct
FROM ph"""
CTES["fx_obs"] = """
WITH w AS (
 SELECT i.phenocam_name, i.date, i.file, c.category, c.class,
  (CASE WHEN c.class_value = (CASE c.category WHEN 'dominant_cover' THEN i.dc WHEN 'crop_status' THEN i.cs ELSE i.ct END) THEN 60 ELSE 0 END)
  + (i.h + 37 * c.class_value * c.class_value + 11 * c.class_value) % 40
  + (CASE WHEN c.class_value = 0 AND i.h % 29 = 0 THEN 200 ELSE 0 END) AS wt
 FROM fx_img i CROSS JOIN fx_classes c)
SELECT phenocam_name, date, file, category, class,
 round(CAST(wt AS DOUBLE) / sum(wt) OVER (PARTITION BY file, category), 4) AS probability
FROM w"""
CTES["fx_pred"] = """
SELECT concat(f.folder, i.file) AS filepath, i.file, i.phenocam_name, i.date
FROM fx_img i JOIN (VALUES ('data/all_images/', 1), ('data/extra_train_images/', 5), ('data/train_images/', 3)) f(folder, step)
  ON i.h % f.step = 0"""
CTES["fx_annotations"] = """
SELECT file, phenocam_name, date, CASE WHEN h % 29 = 0 THEN 0 ELSE cs END AS crop_status, CASE WHEN h % 29 = 0 THEN 0 ELSE ct END AS crop_type,
 CASE WHEN h % 29 = 0 THEN 0 ELSE dc END AS dominant_cover, CAST(h % 60 AS INT) AS time
FROM fx_img WHERE hour = 12 AND h % 3 <> 0"""
CTES["fx_redo"] = """
SELECT file, CASE WHEN time % 11 = 0 THEN 7 WHEN time % 13 = 0 THEN 0 ELSE crop_type END AS crop_type, time
FROM fx_annotations WHERE time % 17 <> 0"""
CTES["fx_extra"] = """
SELECT concat('http://archive.example/data/archive/', phenocam_name, '/', file) AS url, file AS filename, phenocam_name, date, hour FROM fx_img"""
CTES["fx_rois"] = """
SELECT concat('site', CAST(s_suppkey AS VARCHAR(8))) AS phenocam_name, CAST(s_nationkey AS DOUBLE) AS lat, -CAST(s_nationkey AS DOUBLE) AS lon,
 CASE WHEN s_suppkey % 4 = 0 THEN 'GR' ELSE 'AG' END AS roi_type,
 CASE WHEN s_suppkey % 6 = 5 THEN 1001 ELSE 1000 END AS roi_id, CAST(1.5 + CAST(s_suppkey % 8 AS DOUBLE) / 2 AS DOUBLE) AS site_years,
 CASE WHEN s_suppkey % 3 = 0 THEN 'LTAR NEON' ELSE 'NEON' END AS grp FROM supplier
UNION ALL
SELECT 'site1', 0.0, 0.0, 'AG', 2000, 2.5, 'NEON'"""
CTES["fx_transitions"] = """
WITH d AS (SELECT s.site_no, s.phenocam_name, c.date, (dayofyear(c.date) + 13 * s.site_no) % 365 AS phase,
  CAST(floor((dayofyear(c.date) + 13 * s.site_no + 365 * (year(c.date) - 2018)) / 365.0) AS INT) AS cyc
 FROM (SELECT DISTINCT site_no, phenocam_name FROM fx_img) s CROSS JOIN (SELECT DISTINCT date FROM fx_img) c)
SELECT phenocam_name AS site, 'rising' AS direction, 'gcc_90' AS gcc_value,
 max(CASE WHEN phase = 160 THEN date END) AS transition_10, max(CASE WHEN phase = 175 THEN date END) AS transition_25,
 max(CASE WHEN phase = 200 THEN date END) AS transition_50
FROM d GROUP BY phenocam_name, cyc HAVING count(CASE WHEN phase IN (160, 175, 200) THEN 1 END) = 3
UNION ALL
SELECT phenocam_name, 'falling', 'gcc_90', max(CASE WHEN phase = 330 THEN date END), max(CASE WHEN phase = 300 THEN date END),
 max(CASE WHEN phase = 270 THEN date END)
FROM d GROUP BY phenocam_name, cyc HAVING count(CASE WHEN phase IN (270, 300, 330) THEN 1 END) = 3"""
CTES["fx_gcc"] = """
SELECT phenocam_name, date, min(file) AS midday_filename, min(CASE WHEN dc = 4 THEN 1 ELSE 0 END) AS snow_flag,
 round(0.30::DOUBLE + 0.15::DOUBLE * (CASE WHEN min(phase) BETWEEN 160 AND 330 THEN 1 ELSE 0 END) + CAST(min(h) AS DOUBLE) / 20000, 5) AS smooth_gcc_90
FROM fx_img GROUP BY phenocam_name, date"""

# ---- cleaning ------------------------------------------------------------------------------------------
CTES["o_daily"] = """
SELECT o.* FROM fx_obs o JOIN (SELECT phenocam_name, date, min(file) AS file FROM fx_img GROUP BY ALL) USING (phenocam_name, date, file)"""


def top_days(source: str, name: str) -> str:
    return f"""(SELECT DISTINCT phenocam_name, date FROM (
      SELECT *, rank() OVER (PARTITION BY phenocam_name, date ORDER BY probability DESC) AS r
      FROM {source} WHERE category = 'dominant_cover' AND probability IS NOT NULL) WHERE r = 1 AND class = '{name}')"""


def masked(source: str, name: str, categories: str) -> str:
    return f"""
    SELECT o.* REPLACE (CASE WHEN t.date IS NOT NULL AND o.category IN ({categories}) THEN NULL ELSE o.probability END AS probability)
    FROM {source} o LEFT JOIN {top_days(source, name)} t ON o.phenocam_name = t.phenocam_name AND o.date = t.date"""


def interpolated(source: str, gap: int, order: str = "date", position: str | None = None) -> str:
    part = f"PARTITION BY phenocam_name, category, class ORDER BY {order}"
    position = position or f"row_number() OVER ({part})"
    return f"""
    SELECT * EXCLUDE (pos, pp, pv, np, nv) REPLACE (
      CASE WHEN probability IS NOT NULL THEN probability
           WHEN np - pp - 1 <= {gap} THEN pv + (nv - pv) * (CAST(pos - pp AS DOUBLE) / (np - pp)) END AS probability)
    FROM (SELECT *,
        last_value(CASE WHEN probability IS NOT NULL THEN pos END IGNORE NULLS) OVER ({part} {BEFORE}) AS pp,
        last_value(probability IGNORE NULLS) OVER ({part} {BEFORE}) AS pv,
        first_value(CASE WHEN probability IS NOT NULL THEN pos END IGNORE NULLS) OVER ({part} {AFTER}) AS np,
        first_value(probability IGNORE NULLS) OVER ({part} {AFTER}) AS nv
      FROM (SELECT *, {position} AS pos FROM {source}))"""


def renormed(source: str) -> str:
    group = "OVER (PARTITION BY phenocam_name, date, category)"
    return f"""
    SELECT * REPLACE (CASE WHEN count(probability) {group} = count(*) {group}
                      THEN probability / nullif(sum(probability) {group}, 0) END AS probability)
    FROM {source} WHERE class <> 'blurry'"""


def calendar(source: str, classes: str) -> str:
    return f"""
    SELECT d.phenocam_name, d.date, c.category, c.class, o.probability
    FROM (SELECT phenocam_name, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
          FROM {source} GROUP BY phenocam_name) d
    CROSS JOIN (SELECT category, class FROM fx_classes WHERE {classes}) c
    LEFT JOIN {source} o ON o.phenocam_name = d.phenocam_name AND o.date = d.date AND o.category = c.category AND o.class = c.class"""


CROP = "'crop_type','crop_status'"
ALL = "'dominant_cover','crop_type','crop_status'"
CTES["o_snow"] = masked("o_daily", "snow", CROP)
CTES["o_interp1"] = interpolated("o_snow", S.SNOW_GAP_ROWS)
CTES["o_blur"] = masked("o_interp1", "blurry", ALL)
CTES["o_renorm"] = renormed("o_blur")
CTES["o_calendar"] = calendar("o_renorm", "class <> 'blurry'")
CTES["o_interp2"] = interpolated("o_calendar", S.BLUR_GAP_DAYS)
CTES["o_dates"] = """
SELECT phenocam_name, category, date, bool_and(probability IS NOT NULL) AS present FROM o_interp2 GROUP BY ALL"""
CTES["o_ids"] = """
SELECT phenocam_name, category, date, CASE WHEN present THEN CAST(sum(st) OVER (PARTITION BY phenocam_name, category ORDER BY date) AS BIGINT) END AS site_sequence_id
FROM (SELECT *, CASE WHEN present AND NOT coalesce(lag(present) OVER (PARTITION BY phenocam_name, category ORDER BY date), false) THEN 1 ELSE 0 END AS st FROM o_dates)"""
CTES["o_kept"] = f"""
SELECT phenocam_name, category, date, site_sequence_id FROM o_ids WHERE site_sequence_id IS NOT NULL
QUALIFY count(*) OVER (PARTITION BY phenocam_name, category, site_sequence_id) > {S.MIN_SEQUENCE_DAYS}"""
CTES["o_seq"] = """
SELECT o.phenocam_name, CAST(year(o.date) AS INT) AS year, o.date, o.category, o.class, o.probability, k.site_sequence_id
FROM o_interp2 o JOIN o_kept k ON o.phenocam_name = k.phenocam_name AND o.category = k.category AND o.date = k.date"""

# ---- decoding ------------------------------------------------------------------------------------------
SCALE = 1 << 40
CTES["v_seq"] = """
SELECT phenocam_name, category, site_sequence_id, date,
 dense_rank() OVER (ORDER BY category, phenocam_name, site_sequence_id) AS sid,
 row_number() OVER (PARTITION BY phenocam_name, category, site_sequence_id ORDER BY date) AS t
FROM o_kept WHERE category <> 'crop_type'"""


def _viterbi(category: str, tag: str) -> None:
    states, weights = S.HMM_MODELS[category]
    ks = range(len(states))

    def log(x: str) -> str:
        return f"CAST(round(ln({x}) * {SCALE}) AS BIGINT)"

    emit = ", ".join(
        f"max(CASE WHEN o.class = '{s}' AND o.probability > 0 THEN {log('o.probability')} END) AS e{k}" for k, s in enumerate(states)
    )
    CTES[f"v_em_{tag}"] = f"""
    SELECT s.sid, s.t, {emit} FROM v_seq s JOIN o_interp2 o
      ON o.phenocam_name = s.phenocam_name AND o.category = s.category AND o.date = s.date
    WHERE s.category = '{category}' GROUP BY s.sid, s.t"""

    def reach(j: int) -> list[tuple[int, str]]:
        return [
            (i, f"v.s{i} + {log(repr(weights[i][j]) + '::DOUBLE / ' + repr(sum(weights[i])) + '::DOUBLE')}")
            for i in ks
            if weights[i][j] > 0
        ]

    best = [f"greatest({', '.join(x for _, x in reach(j))})" for j in ks]
    back = ["CASE " + " ".join(f"WHEN {x} = {best[j]} THEN {i}" for i, x in reach(j)) + " END" for j in ks]
    start = log(f"1.0::DOUBLE / {len(states)}")
    CTES[f"v_fwd_{tag}"] = f"""
    SELECT sid, t, {', '.join(f'e{k} + {start} AS s{k}' for k in ks)}, {', '.join(f'CAST(NULL AS INT) AS b{k}' for k in ks)}
    FROM v_em_{tag} WHERE t = 1
    UNION ALL
    SELECT e.sid, e.t, {', '.join(f'{best[k]} + e.e{k}' for k in ks)}, {', '.join(back)}
    FROM v_fwd_{tag} v JOIN v_em_{tag} e ON e.sid = v.sid AND e.t = v.t + 1"""
    top = f"greatest({', '.join(f's{k}' for k in ks)})"
    pick = "CASE " + " ".join(f"WHEN s{k} = {top} THEN {k}" for k in ks) + " END"
    CTES[f"v_path_{tag}"] = f"""
    SELECT sid, t, {pick} AS state, {', '.join(f'b{k}' for k in ks)} FROM v_fwd_{tag}
    WHERE (sid, t) IN (SELECT (sid, max(t)) FROM v_em_{tag} GROUP BY sid) AND {top} IS NOT NULL
    UNION ALL
    SELECT v.sid, v.t, CASE p.state {' '.join(f'WHEN {k} THEN p.b{k}' for k in ks)} END, {', '.join(f'v.b{k}' for k in ks)}
    FROM v_path_{tag} p JOIN v_fwd_{tag} v ON v.sid = p.sid AND v.t = p.t - 1"""
    names = "CASE p.state " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(states)) + " END"
    CTES[f"hmm_{tag}"] = f"""
    SELECT s.phenocam_name, CAST(year(s.date) AS INT) AS year, s.date, s.site_sequence_id, s.category, {names} AS hmm_class
    FROM v_seq s JOIN v_path_{tag} p ON p.sid = s.sid AND p.t = s.t"""


_viterbi("dominant_cover", "cover")
_viterbi("crop_status", "status")
CTES["hmm"] = "SELECT * FROM hmm_cover UNION ALL SELECT * FROM hmm_status"

# ---- crop types and final table ------------------------------------------------------------------------
CTES["segments"] = """
SELECT phenocam_name, date, CAST(sum(j) OVER (PARTITION BY phenocam_name ORDER BY date) AS BIGINT) AS crop_sequence_id, crop_status
FROM (SELECT phenocam_name, date, hmm_class AS crop_status,
        CASE WHEN date - lag(date) OVER (PARTITION BY phenocam_name ORDER BY date) <> 1 THEN 1 ELSE 0 END AS j
      FROM hmm_status WHERE hmm_class <> 'no_crop')"""
CTES["vote_sums"] = """
SELECT s.phenocam_name, s.crop_sequence_id, o.class AS crop_class,
 CAST(sum(CAST(round(o.probability * 1099511627776) AS BIGINT)) AS DOUBLE) / 1099511627776 AS total_probability
FROM o_seq o JOIN segments s ON s.phenocam_name = o.phenocam_name AND s.date = o.date
WHERE o.category = 'crop_type' AND o.class <> 'unknown_plant' GROUP BY ALL"""
CTES["votes"] = """
SELECT v.* FROM vote_sums v JOIN fx_classes c ON c.category = 'crop_type' AND c.class = v.crop_class
QUALIFY row_number() OVER (PARTITION BY phenocam_name, crop_sequence_id ORDER BY total_probability DESC, class_value) = 1"""
CTES["modes"] = """
SELECT phenocam_name, crop_sequence_id, crop_status AS most_common_status, n_days FROM (
  SELECT phenocam_name, crop_sequence_id, crop_status, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY phenocam_name, crop_sequence_id) AS BIGINT) AS n_days
  FROM segments GROUP BY 1, 2, 3)
QUALIFY row_number() OVER (PARTITION BY phenocam_name, crop_sequence_id ORDER BY n DESC, crop_status) = 1"""
CTES["ruled"] = f"""
SELECT v.phenocam_name, v.crop_sequence_id,
 CASE WHEN (m.most_common_status = 'emergence' AND m.n_days <= {S.UNKNOWN_CROP_MAX_DAYS}) OR v.crop_class = 'no_crop' THEN 'unknown_plant' ELSE v.crop_class END AS crop_class,
 v.total_probability
FROM votes v LEFT JOIN modes m USING (phenocam_name, crop_sequence_id)"""
CTES["final"] = """
SELECT d.phenocam_name, CAST(year(d.date) AS INT) AS year, d.date, c.hmm_class AS dominant_cover, s.hmm_class AS crop_status,
 CASE WHEN s.hmm_class = 'no_crop' THEN 'no_crop' ELSE r.crop_class END AS crop_type
FROM (SELECT DISTINCT phenocam_name, date FROM hmm) d
LEFT JOIN hmm_cover c ON c.phenocam_name = d.phenocam_name AND c.date = d.date
LEFT JOIN hmm_status s ON s.phenocam_name = d.phenocam_name AND s.date = d.date
LEFT JOIN segments g ON g.phenocam_name = d.phenocam_name AND g.date = d.date
LEFT JOIN ruled r ON r.phenocam_name = g.phenocam_name AND r.crop_sequence_id = g.crop_sequence_id"""
CTES["final_long"] = """
SELECT phenocam_name, year, date, 'dominant_cover' AS category, dominant_cover AS class FROM final
UNION ALL SELECT phenocam_name, year, date, 'crop_type', crop_type FROM final
UNION ALL SELECT phenocam_name, year, date, 'crop_status', crop_status FROM final"""
CTES["signatures"] = (
    "SELECT * FROM (VALUES "
    + ",".join(f"('{c}','{p}','{a}','{n}')" for c, p, a, n in S.TRANSITION_SIGNATURES)
    + ") t(category, prior_day_class, class, transition)"
)

# ---- training set --------------------------------------------------------------------------------------
CTES["ann_kept"] = f"""
SELECT a.file AS filename, a.phenocam_name, a.date, a.dominant_cover, a.crop_type, a.crop_status FROM fx_annotations a
JOIN (SELECT dominant_cover, crop_type, crop_status FROM fx_annotations GROUP BY ALL HAVING count(*) >= {S.MIN_COMBO_IMAGES}) k
 USING (dominant_cover, crop_type, crop_status)"""
CTES["extra_kept"] = """
SELECT * FROM fx_extra WHERE filename NOT IN (SELECT file FROM fx_annotations) AND filename IN (SELECT file FROM fx_img WHERE h % 7 <> 0)"""
CTES["all_images"] = """
SELECT filename, phenocam_name, date, dominant_cover, crop_type, crop_status FROM ann_kept
UNION ALL
SELECT e.filename, e.phenocam_name, e.date, a.dominant_cover, a.crop_type, a.crop_status
FROM extra_kept e JOIN ann_kept a ON a.phenocam_name = e.phenocam_name AND a.date = e.date"""
CTES["split"] = f"""
WITH s AS (SELECT *, regexp_matches(phenocam_name, '(site3)|(site7)') AS held FROM all_images),
n AS (SELECT CAST(floor(count(*) * {S.VALIDATION_FRACTION}::DOUBLE) AS BIGINT) - count(*) FILTER (WHERE held) AS n FROM s)
SELECT filename, held OR row_number() OVER (PARTITION BY held ORDER BY md5(concat('99|', filename)), filename) <= (SELECT n FROM n) AS is_validation FROM s"""
CTES["truth"] = """
WITH a AS (SELECT DISTINCT a.phenocam_name, a.file AS filename, a.date, a.dominant_cover, a.crop_type, a.crop_status,
   CASE WHEN s.is_validation THEN 'val' ELSE 'train' END AS data_type FROM fx_annotations a JOIN split s ON s.filename = a.file),
l AS (SELECT *, 'dominant_cover' AS category, dominant_cover AS class_value FROM a UNION ALL SELECT *, 'crop_type', crop_type FROM a
   UNION ALL SELECT *, 'crop_status', crop_status FROM a)
SELECT l.phenocam_name, l.filename, CAST(year(l.date) AS INT) AS year, l.date, l.category, l.data_type, c.class AS true_class
FROM l LEFT JOIN fx_classes c USING (category, class_value)"""

# ---- evaluation ----------------------------------------------------------------------------------------
CTES["maxprob"] = """
SELECT phenocam_name, file, date, category, class AS maxprob_class FROM (
 SELECT phenocam_name, file, date, category, class, avg(probability) AS p FROM fx_obs GROUP BY ALL)
QUALIFY rank() OVER (PARTITION BY file, category ORDER BY p DESC) = 1"""
CTES["raw_top"] = "SELECT * FROM maxprob WHERE file IN (SELECT file FROM fx_img WHERE h % 7 <> 0)"
CTES["raw_pairs"] = """
SELECT t.*, m.maxprob_class AS predicted_class FROM truth t LEFT JOIN raw_top m ON m.file = t.filename AND m.category = t.category"""
CTES["raw_known"] = "SELECT * FROM raw_pairs WHERE predicted_class IS NOT NULL"
CTES["annotated_first"] = """
SELECT file, category, class FROM fx_obs JOIN fx_classes USING (category, class) WHERE file IN (SELECT file FROM fx_annotations)
QUALIFY row_number() OVER (PARTITION BY file, category ORDER BY probability DESC, class_value) = 1"""
CTES["daily_class"] = """
SELECT o.phenocam_name, CAST(year(o.date) AS INT) AS year, o.date, o.category, o.class FROM o_daily o JOIN fx_classes USING (category, class)
QUALIFY row_number() OVER (PARTITION BY o.phenocam_name, o.date, o.category ORDER BY probability DESC, class_value) = 1"""
CTES["hmm_pairs"] = """
SELECT t.*, f.class AS predicted_class FROM truth t
LEFT JOIN final_long f ON f.phenocam_name = t.phenocam_name AND f.date = t.date AND f.category = t.category
WHERE t.true_class NOT IN ('blurry', 'unknown_plant') AND f.class <> 'unknown_plant'"""
CTES["sizes"] = "SELECT category, true_class AS class, data_type, count(*) AS sample_size FROM truth GROUP BY ALL"


def metrics(pairs: str, terms: tuple[str, ...]) -> str:
    formula = {
        "sensitivity": "tp / nullif(t, 0)",
        "specificity": "tn / nullif(n - t, 0)",
        "pos_pred_value": "tp / nullif(p, 0)",
        "neg_pred_value": "tn / nullif(n - p, 0)",
        "precision": "tp / nullif(p, 0)",
        "recall": "tp / nullif(t, 0)",
        "f1": "2 * (tp / nullif(p, 0)) * (tp / nullif(t, 0)) / nullif(tp / nullif(p, 0) + tp / nullif(t, 0), 0)",
        "prevalence": "t / nullif(n, 0)",
        "detection_rate": "tp / nullif(n, 0)",
        "detection_prevalence": "p / nullif(n, 0)",
        "balanced_accuracy": "(tp / nullif(t, 0) + tn / nullif(n - t, 0)) / 2",
    }
    parts = " UNION ALL ".join(
        f"SELECT category, data_type, class, '{term}' AS term, {formula[term]} AS estimate FROM c" for term in terms
    )
    return f"""
    WITH k AS (SELECT category, data_type, true_class AS class FROM {pairs} UNION SELECT category, data_type, predicted_class FROM {pairs}),
    c AS (SELECT k.category, k.data_type, k.class,
       CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE x.true_class = k.class) AS DOUBLE) AS t,
       CAST(count(*) FILTER (WHERE x.predicted_class = k.class) AS DOUBLE) AS p,
       CAST(count(*) FILTER (WHERE x.true_class = k.class AND x.predicted_class = k.class) AS DOUBLE) AS tp,
       CAST(count(*) FILTER (WHERE x.true_class <> k.class AND x.predicted_class <> k.class) AS DOUBLE) AS tn
      FROM k JOIN {pairs} x ON x.category = k.category AND x.data_type = k.data_type GROUP BY 1, 2, 3)
    {parts}"""


USED = ("precision", "recall", "f1")
CTES["raw_metrics"] = metrics("raw_known", USED)
CTES["final_metrics"] = metrics("hmm_pairs", USED)
OVERALL = """
SELECT m.category, m.term, m.data_type, CASE WHEN count(estimate) = count(*) AND count(sample_size) = count(*) THEN sum(estimate * sample_size) / sum(sample_size) END AS estimate,
 CASE WHEN count(sample_size) = count(*) THEN CAST(sum(sample_size) AS BIGINT) END AS sample_size, 'overall' AS class
FROM {} m LEFT JOIN sizes USING (category, class, data_type) GROUP BY 1, 2, 3"""
CTES["raw_overall"], CTES["final_overall"] = OVERALL.format("raw_metrics"), OVERALL.format("final_metrics")
CTES["display"] = (
    "SELECT * FROM (VALUES "
    + ",".join(f"('{n}',{i},'{S.class_label(n)}')" for i, n in enumerate(S.DISPLAY_ORDER, 1))
    + ") t(class, class_rank, class_label)"
)

# ---- seasons -------------------------------------------------------------------------------------------
CTES["melted"] = """
SELECT site AS phenocam_name, direction, threshold, date FROM (
 SELECT site, direction, 'transition_10' AS threshold, transition_10 AS date FROM fx_transitions WHERE gcc_value = 'gcc_90'
 UNION ALL SELECT site, direction, 'transition_25', transition_25 FROM fx_transitions WHERE gcc_value = 'gcc_90'
 UNION ALL SELECT site, direction, 'transition_50', transition_50 FROM fx_transitions WHERE gcc_value = 'gcc_90')"""
CTES["dense"] = """
WITH cal AS (SELECT phenocam_name, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM melted GROUP BY 1),
j AS (SELECT c.phenocam_name, c.date, m.direction, m.threshold FROM cal c LEFT JOIN melted m USING (phenocam_name, date))
SELECT phenocam_name, date, CASE WHEN direction IS NOT NULL THEN true END AS original_transition_date,
 last_value(direction IGNORE NULLS) OVER w AS direction, last_value(threshold IGNORE NULLS) OVER w AS threshold
FROM j WINDOW w AS (PARTITION BY phenocam_name ORDER BY date, threshold, direction ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
CTES["periods"] = (
    "SELECT d.*, p.period FROM dense d LEFT JOIN (VALUES "
    + ",".join(f"('{d}','{t}','{p}')" for d, t, p in S.SEASON_PERIODS)
    + ") p(direction, threshold, period) USING (direction, threshold)"
)
CTES["season_images"] = """
SELECT p.*, g.midday_filename AS image_filename, g.snow_flag FROM periods p
LEFT JOIN fx_gcc g ON g.phenocam_name = p.phenocam_name AND g.date = p.date AND regexp_matches(g.midday_filename, '.jpg')"""
CTES["season_runs"] = """
WITH a AS (SELECT *, row_number() OVER w AS rn, CASE WHEN image_filename IS NOT NULL AND lag(image_filename) OVER w IS NULL THEN 1 ELSE 0 END AS st
  FROM season_images WINDOW w AS (PARTITION BY phenocam_name ORDER BY date, threshold, direction)),
b AS (SELECT *, sum(st) OVER (PARTITION BY phenocam_name ORDER BY rn) AS id FROM a)
SELECT * EXCLUDE (rn, st, id),
 CAST(CASE WHEN image_filename IS NOT NULL THEN count(image_filename) OVER (PARTITION BY phenocam_name, id ORDER BY rn) ELSE 0 END AS INT) AS running_tally,
 CAST(CASE WHEN image_filename IS NOT NULL THEN id END AS INT) AS site_seq_id
FROM b"""

_WORD = {name: re.compile(rf"\b{name}\b") for name in CTES}


def with_ctes(statement: str) -> str:
    needed: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name, word in _WORD.items():
            if name != own and name not in needed and word.search(text):
                visit(CTES[name], name)
                if name not in needed:
                    needed.append(name)

    visit(statement)
    if not needed:
        return statement
    parts = [f"{name} AS {'' if name in RECURSIVE else 'MATERIALIZED '}({CTES[name]})" for name in needed]
    if statement.lstrip().startswith("WITH"):
        statement = f"SELECT * FROM ({statement})"
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + statement


RECURSIVE = {name for name in CTES if name.startswith(("v_fwd_", "v_path_"))}
