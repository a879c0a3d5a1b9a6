"""One statement per registered query."""

from __future__ import annotations

from fieldstate import schema as S
from oracle import ctes as C

Q: dict[str, str] = {}

PARSE = r"'^([^_]+)_(\d{4})_(\d{2})_(\d{2})_(\d{2})(\d{2})(\d{2})\.jpg$'"


def flat(source: str, keys: str, classes: dict[str, tuple[str, ...]], digits: int, join: str = "-") -> str:
    """Pivot long rows to one column per category and class."""
    columns = ", ".join(
        f"round(max(CASE WHEN category = '{c}' AND class = '{n}' THEN probability END), {digits}) AS \"{c}{join}{n}\""
        for c, names in classes.items()
        for n in names
    )
    return f"SELECT {keys}, {columns} FROM {source} GROUP BY {keys}"


CLEAN = {c: names[1:] for c, names in S.CLASSES.items()}

# ---- sources, manifests --------------------------------------------------------------------------------
Q["archive_url"] = """
SELECT file, concat('http://archive.example/data/archive/', phenocam_name, '/', CAST(year(date) AS VARCHAR), '/',
 strftime(date, '%m'), '/', file) AS url FROM fx_img"""
Q["browse_url"] = """
SELECT DISTINCT phenocam_name, date, concat('http://archive.example/browse/', phenocam_name, '/', strftime(date, '%Y/%m/%d')) AS url FROM fx_img"""
Q["transition_file_name"] = """
SELECT concat('gcc/', phenocam_name, '_', roi_type, '_', CAST(roi_id AS VARCHAR), '_1day.csv') AS path,
 concat('gcc/', phenocam_name, '_', roi_type, '_', CAST(roi_id AS VARCHAR), '_1day_transition_dates.csv') AS transition_path FROM fx_rois"""
# found another way: comments and elements without markup are cut out, the rest is split at "<"
Q["extract_links"] = r"""
WITH cut AS (SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?(?:-->|$)|<(?:script|style|textarea|title)[\s/>].*?</(?:script|style|textarea|title)[\s>]', ' ', 'g') AS html FROM pages),
tags AS (SELECT page_id, url, unnest(string_split(html, '<')) AS tag FROM cut),
found AS (SELECT page_id, url, regexp_extract(tag, '(?is)^a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS h, tag FROM tags
 WHERE regexp_matches(tag, '(?is)^a\s(?:[^>]*?\s)?href\s*='))
SELECT page_id, url, concat('http://archive.example', href) AS link FROM (
 SELECT page_id, url, replace(replace(concat(h.a, h.b, h.c), '&quot;', '"'), '&amp;', '&') AS href FROM found)
WHERE regexp_matches(href, '^/[a-z]*') AND regexp_matches(href, 'a|the')"""
Q["fetch_audit"] = """
SELECT filename, phenocam_name, date, url FROM fx_extra WHERE filename NOT IN (SELECT file FROM fx_img WHERE h % 7 <> 0)"""
Q["fetch_summary"] = """
SELECT count(*) AS expected, count(*) FILTER (WHERE filename IN (SELECT file FROM fx_img WHERE h % 7 <> 0)) AS present,
 count(*) FILTER (WHERE filename NOT IN (SELECT file FROM fx_img WHERE h % 7 <> 0)) AS failed FROM fx_extra"""

# ---- parsing, sites ------------------------------------------------------------------------------------
Q["parse_image_file"] = f"""
SELECT file, regexp_extract(file, {PARSE}, 1) AS phenocam_name,
 strptime(substr(file, length(file) - 20, 17), '%Y_%m_%d_%H%M%S') AS datetime,
 CAST(regexp_extract(file, {PARSE}, 2) AS INT) AS year, date FROM fx_img"""
Q["parse_site_date"] = """
SELECT file, split_part(file, '_', 1) AS phenocam_name,
 concat(split_part(file, '_', 2), '-', split_part(file, '_', 3), '-', split_part(file, '_', 4)) AS date FROM fx_img"""
Q["parse_file_parts"] = """
SELECT url, filename, phenocam_name, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day,
 CAST(hour AS INT) AS hour, date FROM fx_extra"""
Q["hour_filter"] = """
SELECT filename, phenocam_name, date, hour FROM fx_extra WHERE hour IN (9, 10, 11)"""
Q["select_sites"] = """
SELECT phenocam_name, lat, lon, roi_type, roi_id, site_years FROM fx_rois
WHERE roi_type = 'AG' AND site_years > 2 AND roi_id % 1000 = 0 AND phenocam_name NOT IN ('site2', 'site5', 'site11')"""
Q["site_group_flag"] = """
SELECT r.phenocam_name, r.roi_id, r.phenocam_name IN (SELECT phenocam_name FROM fx_rois WHERE contains(grp, 'LTAR')) AS is_ltar FROM fx_rois r"""
Q["site_table"] = """
SELECT CAST(row_number() OVER (ORDER BY phenocam_name, roi_id) AS INT) AS number, phenocam_name,
 CASE WHEN phenocam_name IN (SELECT phenocam_name FROM fx_rois WHERE contains(grp, 'LTAR')) THEN 'yes' ELSE 'no' END AS ltar_site,
 lat, lon, roi_type, roi_id, site_years FROM fx_rois"""

# ---- seasons, sampling ---------------------------------------------------------------------------------
Q["melt_thresholds"] = "SELECT phenocam_name, direction, threshold, date FROM melted"
Q["densify_locf"] = "SELECT phenocam_name, direction, threshold, date, original_transition_date FROM dense"
Q["season_period"] = "SELECT phenocam_name, direction, threshold, date, original_transition_date, period FROM periods"
Q["asof_season"] = """
SELECT i.phenocam_name, i.date, i.file, p.period FROM fx_img i LEFT JOIN (
 SELECT phenocam_name, date, period FROM periods
 QUALIFY row_number() OVER (PARTITION BY phenocam_name, date ORDER BY threshold DESC, direction DESC) = 1) p
 ON p.phenocam_name = i.phenocam_name AND p.date = i.date"""
RUN_COLUMNS = "phenocam_name, direction, threshold, date, original_transition_date, period, image_filename, snow_flag"
Q["attach_midday_image"] = f"SELECT {RUN_COLUMNS} FROM season_images"
Q["present_runs"] = f"SELECT {RUN_COLUMNS}, running_tally, site_seq_id FROM season_runs"
Q["full_image_list"] = f"SELECT {RUN_COLUMNS}, running_tally, site_seq_id FROM season_runs WHERE image_filename IS NOT NULL"
Q["sample_per_group"] = f"""
SELECT {RUN_COLUMNS}, running_tally, site_seq_id FROM season_runs WHERE image_filename IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY phenocam_name, period ORDER BY md5(concat('99|', image_filename)), image_filename) <= {S.IMAGES_PER_PERIOD}"""
Q["sample_distinct"] = """
SELECT file FROM (SELECT DISTINCT file FROM fx_annotations) ORDER BY md5(concat('99|', file)), file LIMIT 50"""

# ---- training set --------------------------------------------------------------------------------------
Q["merge_annotations"] = """
SELECT a.file, a.crop_status, CASE WHEN a.crop_status IN (1,2,3,4,5) AND r.crop_type = 7 THEN 1 WHEN a.crop_status = 0 THEN 0
  WHEN a.crop_status = 6 THEN 7 WHEN a.crop_type = 6 AND r.crop_type = 0 THEN 7 ELSE r.crop_type END AS crop_type, a.dominant_cover, a.time
FROM fx_annotations a LEFT JOIN fx_redo r USING (file)"""
Q["drop_annotated_extras"] = """
SELECT filename, url, phenocam_name, date, hour FROM fx_extra e WHERE NOT EXISTS (SELECT 1 FROM fx_annotations a WHERE a.file = e.filename)"""
Q["keep_available_extras"] = """
SELECT filename, url, phenocam_name, date, hour FROM fx_extra WHERE filename IN (SELECT file FROM fx_img WHERE h % 7 <> 0)"""
Q["drop_rare_combos"] = """
SELECT file AS filename, phenocam_name, date, dominant_cover, crop_type, crop_status FROM fx_annotations
QUALIFY count(*) OVER (PARTITION BY dominant_cover, crop_type, crop_status) >= 150"""
Q["propagate_labels"] = "SELECT filename, phenocam_name, date, dominant_cover, crop_type, crop_status FROM all_images"
Q["holdout_split"] = "SELECT filename, is_validation FROM split"
Q["split_assertions"] = """
SELECT 'holdout_site_in_train' AS rule, CAST(count(*) FILTER (WHERE NOT is_validation AND regexp_matches(split_part(filename, '_', 1), '(site3)|(site7)')) AS BIGINT) AS violations FROM split
UNION ALL SELECT 'duplicates_in_train', CAST(count(*) FILTER (WHERE NOT is_validation) - count(DISTINCT CASE WHEN NOT is_validation THEN filename END) AS BIGINT) FROM split
UNION ALL SELECT 'duplicates_in_validation', CAST(count(*) FILTER (WHERE is_validation) - count(DISTINCT CASE WHEN is_validation THEN filename END) AS BIGINT) FROM split"""
Q["balanced_weights"] = """
SELECT filename, dominant_cover, crop_type, crop_status, round(CAST((SELECT count(*) FROM all_images) AS DOUBLE)
 / ((SELECT count(*) FROM (SELECT DISTINCT dominant_cover, crop_type, crop_status FROM all_images)) * count(*) OVER (PARTITION BY dominant_cover, crop_type, crop_status)), 9) AS sample_weight
FROM all_images"""
Q["resample_balanced"] = f"""
WITH train AS (SELECT a.* FROM all_images a JOIN split s USING (filename) WHERE NOT s.is_validation),
r AS (SELECT *, row_number() OVER (PARTITION BY dominant_cover, crop_type, crop_status ORDER BY md5(concat('99|', filename)), filename) - 1 AS pos FROM train),
c AS (SELECT dominant_cover, crop_type, crop_status, count(*) AS n, row_number() OVER (ORDER BY dominant_cover, crop_type, crop_status) - 1 AS combo FROM train GROUP BY 1, 2, 3),
d AS (SELECT i AS draw, md5(concat('99|', CAST(i AS VARCHAR))) AS k FROM range({S.RESAMPLE_SIZE}) t(i)),
p AS (SELECT d.draw, c.*, CAST('0x' || substr(d.k, 9, 13) AS BIGINT) % c.n AS pos FROM d JOIN c ON c.combo = CAST('0x' || substr(d.k, 1, 8) AS BIGINT) % (SELECT count(*) FROM c))
SELECT p.draw, r.filename, r.dominant_cover, r.crop_type, r.crop_status FROM p
JOIN r ON r.dominant_cover = p.dominant_cover AND r.crop_type = p.crop_type AND r.crop_status = p.crop_status AND r.pos = p.pos"""
BITS = {c: [f"CAST({c} = {k} AS INT)" for k in range(w)] for c, w in S.WIDTHS.items()}
Q["one_hot_targets"] = "SELECT file, array_to_string([{}], ',') AS target FROM fx_annotations".format(
    ", ".join(b for bits in BITS.values() for b in bits)
)
Q["split_targets"] = "SELECT file, {} FROM fx_annotations".format(
    ", ".join(f"array_to_string([{', '.join(bits)}], ',') AS {c}_target" for c, bits in BITS.items())
)
Q["crop_plan"] = """
WITH m AS (SELECT file, CAST(200 + h % 800 AS INT) AS height, CAST(500 + h * 7 % 800 AS INT) AS width FROM fx_img),
s AS (SELECT m.*, CAST(coalesce(
  CASE WHEN height - floor(height * 0.5::DOUBLE) >= 224 THEN floor(height * 0.5::DOUBLE) END,
  CASE WHEN height - floor(height * (0.5::DOUBLE - 0.1::DOUBLE)) >= 224 THEN floor(height * (0.5::DOUBLE - 0.1::DOUBLE)) END,
  CASE WHEN height - floor(height * (0.5::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE)) >= 224 THEN floor(height * (0.5::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE)) END,
  CASE WHEN height - floor(height * (0.5::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE)) >= 224 THEN floor(height * (0.5::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE)) END,
  CASE WHEN height - floor(height * (0.5::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE)) >= 224 THEN floor(height * (0.5::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE)) END,
  CASE WHEN height >= 224 THEN 0 END
  ) AS BIGINT) AS trim FROM m),
k AS (SELECT s.*, CAST(i AS INT) AS i, md5(concat('99|', file, '#', CAST(i AS VARCHAR))) AS k FROM s, range(3) t(i))
SELECT file, height, width, i, CAST(trim + 1 + CAST('0x' || substr(k, 1, 8) AS BIGINT) % (height - trim - 225) AS INT) AS y0,
 CAST(1 + CAST('0x' || substr(k, 9, 8) AS BIGINT) % (width - 225) AS INT) AS x0
FROM k WHERE height - trim - 225 > 0 AND width - 225 > 0"""
Q["crop_plan_violations"] = f"SELECT file, height, width FROM (SELECT file, CAST(200 + h % 800 AS INT) AS height, CAST(500 + h * 7 % 800 AS INT) AS width FROM fx_img) WHERE file NOT IN (SELECT file FROM ({Q['crop_plan']}))"

# ---- scoring -------------------------------------------------------------------------------------------
def _scored() -> str:
    heads = []
    for c, w in S.WIDTHS.items():
        logits = ", ".join(
            f"list_sum([x * (((d * 17 + {(k + len(c)) * 31}) % 13) - 6) / 40.0::DOUBLE for x, d in CAST(embedding AS DOUBLE[])])" for k in range(w)
        )
        heads.append(f"[{logits}] AS z_{c}")
    return f"SELECT vec_id, {', '.join(heads)} FROM embeddings"


def _softmax(c: str) -> str:
    e = f"[exp(v - list_max(z_{c})) for v in z_{c}]"
    return f"[round(v / list_sum({e}), 4) for v in {e}]"


Q["score_images"] = "WITH z AS ({}), p AS (SELECT vec_id, {} FROM z) SELECT vec_id, {} FROM p".format(
    _scored(),
    ", ".join(f"{_softmax(c)} AS p_{c}" for c in S.WIDTHS),
    ", ".join(f'p_{c}[{k + 1}] AS "{c}-{n}"' for c, names in S.CLASSES.items() for k, n in enumerate(names)),
)
Q["argmax_label"] = "WITH z AS ({}), p AS (SELECT vec_id, {} FROM z) SELECT vec_id, {} FROM p".format(
    _scored(),
    ", ".join(f"{_softmax(c)} AS p_{c}" for c in S.WIDTHS),
    ", ".join(f"CAST(list_position(p_{c}, list_max(p_{c})) - 1 AS INT) AS {c}" for c in S.WIDTHS),
)

# ---- cleaning ------------------------------------------------------------------------------------------
Q["drop_extra_and_dups"] = flat(
    "(SELECT DISTINCT '' AS filepath, p.file, o.category, o.class, o.probability FROM fx_pred p JOIN fx_obs o USING (file) WHERE NOT contains(p.filepath, 'extra_train_images'))",
    "filepath, file", S.CLASSES, 4,
)
Q["first_image_per_day"] = flat("o_daily", "phenocam_name, date, file", S.CLASSES, 4)
Q["wide_to_long"] = "SELECT phenocam_name, date, file, category, class, probability FROM o_daily"
Q["long_to_wide"] = flat("o_daily", "phenocam_name, date, file", S.CLASSES, 4)
Q["mask_snow_days"] = "WITH b AS ({}) {}".format(
    C.masked("fx_obs", "snow", C.CROP), flat("b", "phenocam_name, date, file", S.CLASSES, 4)
)
Q["mask_blurry_days"] = "WITH b AS ({}) {}".format(
    C.masked("fx_obs", "blurry", C.ALL), flat("b", "phenocam_name, date, file", S.CLASSES, 4)
)
Q["drop_blurry_renorm"] = "WITH b AS ({}), r AS ({}) {}".format(
    C.masked("o_daily", "blurry", C.ALL), C.renormed("b"), flat("r", "phenocam_name, date, file", CLEAN, 6)
)
Q["fill_calendar"] = "WITH c AS ({}) {}".format(
    """SELECT d.phenocam_name, d.date, CAST(year(d.date) AS INT) AS year, o.file, o.category, o.class, o.probability FROM
 (SELECT phenocam_name, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM fx_img GROUP BY 1) d
 LEFT JOIN fx_obs o ON o.phenocam_name = d.phenocam_name AND o.date = d.date""",
    flat("c", "phenocam_name, date, year, file", S.CLASSES, 4),
)
Q["interpolate_gaps"] = flat("o_interp1", "phenocam_name, date", S.CLASSES, 9)
Q["interpolate_gaps_by_date"] = "WITH i AS ({}) {}".format(
    C.interpolated("o_snow", 5, position="date_diff('day', DATE '1970-01-01', date)"), flat("i", "phenocam_name, date", S.CLASSES, 9)
)
Q["interpolate_gaps_long"] = "WITH b AS ({}), i AS ({}) SELECT phenocam_name, date, category, class, round(probability, 9) AS probability FROM i".format(
    C.masked("o_daily", "blurry", C.ALL), C.interpolated("b", 3)
)
Q["sequence_ids"] = """
SELECT d.phenocam_name, d.date, {} FROM (SELECT DISTINCT phenocam_name, date FROM o_dates) d {}""".format(
    ", ".join(f"{c}.site_sequence_id AS {c}_seq, {c}.n AS {c}_days" for c in S.CATEGORIES),
    " ".join(
        f"LEFT JOIN (SELECT *, CASE WHEN site_sequence_id IS NOT NULL THEN CAST(count(*) OVER (PARTITION BY phenocam_name, site_sequence_id) AS INT) END AS n "
        f"FROM o_ids WHERE category = '{c}') {c} ON {c}.phenocam_name = d.phenocam_name AND {c}.date = d.date"
        for c in S.CATEGORIES
    ),
)
Q["min_sequence"] = "SELECT phenocam_name, date, category, site_sequence_id FROM o_kept"
for _c, _tag in (("dominant_cover", "cover"), ("crop_status", "status")):
    Q[f"prep_for_hmm_{_tag}"] = "SELECT phenocam_name, year, date, category, site_sequence_id, {} FROM o_seq WHERE category = '{}' GROUP BY 1, 2, 3, 4, 5".format(
        ", ".join(f"round(max(CASE WHEN class = '{n}' THEN probability END), 6) AS {n}" for n in CLEAN[_c]), _c
    )
Q["prep_for_hmm_type"] = """
SELECT phenocam_name, year, date, category, class, round(probability, 6) AS probability, site_sequence_id FROM o_seq WHERE category = 'crop_type'"""
Q["prep_profile_simple"] = "WITH c AS ({}), b AS ({}), i AS ({}) {}".format(
    """SELECT phenocam_name, date, file, category, class, probability FROM fx_obs UNION ALL
       SELECT d.phenocam_name, d.date, NULL, c.category, c.class, NULL FROM
        (SELECT phenocam_name, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM fx_img GROUP BY 1) d
       ANTI JOIN fx_img i ON i.phenocam_name = d.phenocam_name AND i.date = d.date CROSS JOIN fx_classes c""",
    C.masked("c", "blurry", C.ALL),
    C.interpolated("b", S.PROFILE_GAP_ROWS, order="date, file"),
    flat("i", "phenocam_name, date, file", S.CLASSES, 9),
)
Q["sequence_violations"] = """
SELECT phenocam_name, date, category, missing AS share_missing FROM (
 SELECT phenocam_name, date, category, count(*) AS n, avg(CASE WHEN probability IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS missing, count(DISTINCT file) AS files
 FROM fx_obs GROUP BY 1, 2, 3) WHERE files > 1 OR missing NOT IN (0.0, 1.0)"""

# ---- decoding ------------------------------------------------------------------------------------------
HMM_COLUMNS = "phenocam_name, year, date, site_sequence_id, category, hmm_class"
Q["emission_logprob"] = """
SELECT phenocam_name, date, category, class, CASE WHEN probability > 0 THEN CAST(round(ln(probability), 6) AS VARCHAR) IS NOT NULL AND true ELSE false END AS possible,
 CASE WHEN probability > 0 THEN round(ln(probability), 6) END AS logprob FROM o_daily WHERE category <> 'crop_type'"""
Q["viterbi_decode"] = Q["viterbi_decode_long"] = f"SELECT {HMM_COLUMNS} FROM hmm"
Q["hmm_failures"] = """
SELECT phenocam_name, category, site_sequence_id, count(*) AS n_days FROM o_kept WHERE category <> 'crop_type'
GROUP BY 1, 2, 3 HAVING bool_or(phenocam_name LIKE '%3' AND day(date) = 15)"""
Q["hmm_output"] = f"SELECT {HMM_COLUMNS} FROM hmm"

# ---- crop types, final table, transitions --------------------------------------------------------------
Q["crop_segments"] = "SELECT phenocam_name, date, crop_sequence_id, crop_status FROM segments"
Q["vote_crop_type"] = "SELECT phenocam_name, crop_sequence_id, crop_class, round(total_probability, 6) AS total_probability FROM votes"
Q["segment_mode_status"] = "SELECT phenocam_name, crop_sequence_id, most_common_status, n_days FROM modes"
Q["unknown_rules"] = "SELECT phenocam_name, crop_sequence_id, crop_class, round(total_probability, 6) AS total_probability FROM ruled"
Q["vote_uniqueness_check"] = """
SELECT phenocam_name, crop_sequence_id, count(*) AS n FROM (SELECT * FROM vote_sums
 QUALIFY rank() OVER (PARTITION BY phenocam_name, crop_sequence_id ORDER BY total_probability DESC) = 1) GROUP BY 1, 2 HAVING count(*) > 1"""
FINAL_COLUMNS = "phenocam_name, year, date, dominant_cover, crop_status, crop_type"
Q["final_predictions"] = f"SELECT {FINAL_COLUMNS} FROM final"
Q["field_states"] = f"SELECT {FINAL_COLUMNS} FROM final"
TRANSITIONS = """
SELECT a.phenocam_name, a.year, a.date, a.category, a.class, b.class AS prior_day_class, s.transition, CAST(dayofyear(a.date) AS INT) AS doy
FROM {src} a JOIN {src} b ON b.phenocam_name = a.phenocam_name AND b.category = a.category AND b.date + 1 = a.date
JOIN signatures s ON s.category = a.category AND s.prior_day_class = b.class AND s.class = a.class"""
Q["state_transitions"] = TRANSITIONS.format(src="final_long")
Q["state_transitions_maxprob"] = """
""" + TRANSITIONS.format(src="daily_class")
_half = "OVER (PARTITION BY phenocam_name ORDER BY date ROWS BETWEEN {} AND {})"


def _change(value: str, half: int) -> str:
    a, b = _half.format(f"{half} PRECEDING", "1 PRECEDING"), _half.format("1 FOLLOWING", f"{half} FOLLOWING")
    return f"CASE WHEN count({value}) {a} = {half} AND count({value}) {b} = {half} THEN avg({value}) {b} - avg({value}) {a} END"


COVER = """(SELECT phenocam_name, date, max(CASE WHEN class = 'vegetation' THEN probability END) AS veg,
 max(CASE WHEN class = 'soil' THEN probability END) + max(CASE WHEN class = 'residue' THEN probability END) AS bare
 FROM o_daily WHERE category = 'dominant_cover' GROUP BY 1, 2)"""
Q["mean_change"] = f"SELECT phenocam_name, date, round({_change('veg', 4)}, 6) AS vegetation_change FROM {COVER}"
Q["harvest_detect"] = f"""
SELECT phenocam_name, date, coalesce(({_change('veg', 3)}) <= {S.HARVEST_VEGETATION}::DOUBLE AND ({_change('bare', 3)}) >= {S.HARVEST_SOIL_RESIDUE}::DOUBLE, false) AS transition_harvest
FROM {COVER}"""
Q["publish_join"] = f"""
SELECT f.phenocam_name, year, date, dominant_cover, crop_status, crop_type, lat, lon, roi_type, roi_id, site_years FROM final f LEFT JOIN (
 SELECT phenocam_name, arg_max(lat, roi_id) AS lat, arg_max(lon, roi_id) AS lon, arg_max(roi_type, roi_id) AS roi_type,
  CAST(max(roi_id) AS INT) AS roi_id, max(site_years) AS site_years FROM fx_rois GROUP BY 1) s USING (phenocam_name)"""

# ---- evaluation ----------------------------------------------------------------------------------------
Q["maxprob_class"] = "SELECT phenocam_name, file, date, category, maxprob_class FROM maxprob"
Q["maxprob_first"] = """
SELECT phenocam_name, file, date, category, class AS maxprob_class FROM (
 SELECT phenocam_name, file, date, category, class, avg(probability) AS p FROM fx_obs GROUP BY ALL) JOIN fx_classes USING (category, class)
QUALIFY row_number() OVER (PARTITION BY file, category ORDER BY p DESC, class_value) = 1"""
Q["truth_table"] = "SELECT phenocam_name, filename, year, date, category, data_type, true_class FROM truth"
Q["split_counts"] = """
SELECT CASE WHEN is_validation THEN 'val' ELSE 'train' END AS data_type, split_part(filename, '_', 1) IN ('site3', 'site7') AS is_validation_site,
 count(*) AS n, count(DISTINCT filename) AS n_files FROM split GROUP BY 1, 2"""
Q["truth_counts"] = """
SELECT data_type, phenocam_name IN ('site3', 'site7') AS is_validation_site, count(DISTINCT filename) AS n_images FROM truth GROUP BY 1, 2"""
Q["undated_files"] = "SELECT concat('thumb_', h, '.jpg') AS file FROM fx_img WHERE h % 10 = 0"
Q["sample_sizes"] = "SELECT category, class, data_type, sample_size FROM sizes"
Q["coverage_check_raw"] = """
SELECT round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS percent, count(*) FILTER (WHERE ok) AS num FROM (
 SELECT t.filename, bool_and(m.maxprob_class IS NOT NULL) AS ok FROM truth t LEFT JOIN raw_top m ON m.file = t.filename AND m.category = t.category GROUP BY 1)"""
Q["coverage_check_final"] = """
SELECT round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS percent, count(*) FILTER (WHERE ok) AS num FROM (
 SELECT t.filename, bool_and(f.class IS NOT NULL) AS ok FROM truth t
 LEFT JOIN final_long f ON f.phenocam_name = t.phenocam_name AND f.date = t.date AND f.category = t.category GROUP BY 1)"""
Q["hmm_eval_set"] = "SELECT phenocam_name, filename, year, date, category, data_type, true_class, predicted_class AS hmm_class FROM hmm_pairs"
Q["class_metrics_raw"] = "SELECT category, data_type, class, term, round(estimate, 4) AS estimate FROM ({})".format(
    C.metrics("raw_known", ("sensitivity", "specificity", "pos_pred_value", "neg_pred_value", "precision", "recall", "f1",
                            "prevalence", "detection_rate", "detection_prevalence", "balanced_accuracy"))
)
Q["class_metrics_final"] = "SELECT category, data_type, class, term, round(estimate, 4) AS estimate FROM final_metrics"
OVERALL = "SELECT category, term, data_type, round(estimate, 4) AS estimate, sample_size, class FROM {}"
Q["overall_metrics"], Q["overall_metrics_final"] = OVERALL.format("raw_overall"), OVERALL.format("final_overall")
MATRIX = """
WITH n AS (SELECT category, data_type, true_class, predicted_class, count(*) AS n FROM {pairs} GROUP BY ALL),
g AS (SELECT a.category, a.data_type, b.true_class, c.predicted_class FROM (SELECT DISTINCT category, data_type FROM n) a
 JOIN (SELECT DISTINCT category, true_class FROM n) b USING (category) JOIN (SELECT DISTINCT category, predicted_class FROM n) c USING (category))
SELECT g.category, g.data_type, g.true_class, g.predicted_class, coalesce(n.n, 0) AS n FROM g LEFT JOIN n
 ON n.category = g.category AND n.data_type = g.data_type AND n.true_class = g.true_class AND n.predicted_class IS NOT DISTINCT FROM g.predicted_class"""
Q["confusion_matrix_raw"] = MATRIX.format(pairs="raw_pairs")
Q["confusion_matrix_final"] = MATRIX.format(pairs="hmm_pairs")
LABELS = """
WITH m AS ({rows}),
w AS (SELECT category, term, class, max(CASE WHEN data_type = 'val' THEN estimate END) AS v, max(CASE WHEN data_type = 'train' THEN estimate END) AS t,
 max(CASE WHEN data_type = 'val' THEN sample_size END) + max(CASE WHEN data_type = 'train' THEN sample_size END) AS n FROM m GROUP BY 1, 2, 3)
SELECT w.category, w.term, w.class, concat(coalesce(printf('%.2f', round(v, 2)), 'NA'), ', ', coalesce(printf('%.2f', round(t, 2)), 'NA'), ' (', coalesce(CAST(n AS VARCHAR), 'NA'), ')') AS error_text{more} FROM w"""
SIZED = "SELECT m.category, m.term, m.class, m.data_type, m.estimate, s.sample_size FROM {}_metrics m LEFT JOIN sizes s USING (category, class, data_type)"
Q["metric_labels"] = LABELS.format(rows=SIZED.format("raw"), more="")
FACET = """, d.class_label, concat(upper(w.term[1]), w.term[2:], ': ', CASE w.category WHEN 'dominant_cover' THEN 'Dominant Cover' WHEN 'crop_type' THEN 'Crop Type' ELSE 'Crop Status' END) AS facet_label"""
for _kind in ("raw", "final"):
    _rows = SIZED.format(_kind) + f" UNION ALL SELECT category, term, class, data_type, estimate, sample_size FROM {_kind}_overall"
    Q[f"report_labels_{_kind}"] = LABELS.format(rows=_rows, more=FACET) + " LEFT JOIN display d USING (class)"
Q["class_rank_label"] = """
SELECT s.category, s.class, s.data_type, s.sample_size, CAST(d.class_rank AS INT) AS class_rank, d.class_label FROM sizes s LEFT JOIN display d USING (class)"""
Q["timeseries_panel"] = """
SELECT x.*, CAST(d.class_rank AS INT) AS class_rank FROM (
 SELECT 'probability' AS series, phenocam_name, CAST(year(date) AS INT) AS year, date, category, class, probability FROM fx_obs
 UNION ALL SELECT 'maxprob', phenocam_name, CAST(year(date) AS INT), date, category, maxprob_class, NULL FROM maxprob
 UNION ALL SELECT 'hmm', phenocam_name, year, date, category, class, NULL FROM final_long) x LEFT JOIN display d USING (class)"""
Q["timeseries_panel_year"] = f"SELECT * FROM ({Q['timeseries_panel']}) WHERE year = 2019 AND category = 'dominant_cover'"
Q["site_years"] = f"""
SELECT phenocam_name, CAST(year(date) AS INT) AS year, count(DISTINCT date) AS n_days FROM fx_img GROUP BY 1, 2 HAVING count(DISTINCT date) >= {S.SITE_YEAR_MIN_DAYS}"""
Q["image_diagnostic"] = """
SELECT o.file AS filename, o.category, o.class, o.probability, o.class = m.class AS is_maxprob_class, o.class = t.true_class AS is_true_class,
 CASE WHEN o.class = t.true_class THEN CASE WHEN o.probability < 0.5 THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END END AS label_x, CAST(d.class_rank AS INT) AS class_rank
FROM fx_obs o JOIN truth t ON t.filename = o.file AND t.category = o.category
JOIN annotated_first m ON m.file = o.file AND m.category = o.category
LEFT JOIN display d ON d.class = o.class"""
Q["greenness_vs_status"] = """
SELECT coalesce(g.phenocam_name, f.phenocam_name) AS phenocam_name, CAST(year(coalesce(g.date, f.date)) AS INT) AS year,
 CAST(dayofyear(coalesce(g.date, f.date)) AS INT) AS doy, strftime(DATE '2018-01-01' + CAST(dayofyear(coalesce(g.date, f.date)) - 1 AS INT), '%b %d') AS day_label,
 g.smooth_gcc_90 AS gcc, f.crop_status
FROM fx_gcc g FULL JOIN final f ON f.phenocam_name = g.phenocam_name AND f.date = g.date"""

QUERIES = {name: C.with_ctes(sql).strip() for name, sql in Q.items()}
