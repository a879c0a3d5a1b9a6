"""Plan shape: shuffles of the pipeline, pushed-down columns and filters, no products of tables."""

import re

import pytest

from fieldstate.plans import catalog, field_states
from fieldstate.sources import derived as D

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def predictions(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pred") / "t")
    D.predictions(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def test_pipeline_shuffles_three_times(predictions):
    plan = plan_of(field_states.field_states(predictions, catalog.EXTRA))
    exchanges = re.findall(r"Exchange (\w+)\((.*?), \d+\)", plan)
    keys = [re.sub(r"#\d+", "", k) for _, k in exchanges]
    assert keys == ["phenocam_name", "phenocam_name", "phenocam_name, date"]
    assert "WindowGroupLimit" in plan  # a day's images are reduced before they are shuffled


def test_scan_reads_only_needed_columns_and_filters(predictions):
    plan = plan_of(field_states.field_states(predictions, catalog.EXTRA))
    scan = re.search(r"FileScan parquet.*", plan).group(0)
    assert "Not Contains(filepath" in scan or "StringContains(filepath" in scan
    lineitem = re.search(r"FileScan parquet.*", plan_of(catalog.QUERIES["site_years"](predictions.sparkSession, SF))).group(0)
    assert "l_quantity" not in lineitem and "l_shipdate" in lineitem


# one query per kind of join or grid
JOINING = (
    "asof_season", "attach_midday_image", "balanced_weights", "class_metrics_raw", "confusion_matrix_raw", "drop_rare_combos",
    "fetch_audit", "final_predictions", "greenness_vs_status", "image_diagnostic", "melt_thresholds", "prep_profile_simple",
    "propagate_labels", "publish_join", "resample_balanced", "site_group_flag", "timeseries_panel",
)


@pytest.mark.parametrize("name", JOINING)
def test_no_product_of_tables(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stored_panel_is_read_in_part(spark, tmp_path):
    """A year of one category opens only its own folder, and the site is pushed to the files."""
    from fieldstate.operators import evaluate

    panel = evaluate.timeseries_panel(D.observations(spark, SF), catalog.final(spark, SF))
    path = str(tmp_path / "panel")
    evaluate.store_panel(panel, path)
    everything = evaluate.read_panel(spark, path)
    part = evaluate.read_panel(spark, path, site="site3", year=2019, category="dominant_cover")
    assert everything.columns == list(evaluate.PANEL) and everything.count() == panel.count()
    want = panel.filter("phenocam_name = 'site3' AND year = 2019 AND category = 'dominant_cover'")
    assert sorted(map(str, part.collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    scan = re.search(r"FileScan parquet.*", plan_of(evaluate.read_panel(spark, path, site="site3", year=2019, category="dominant_cover"))).group(0)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    partition = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", scan)
    assert "category" in partition.group(1) and "year" in partition.group(1) and "EqualTo(phenocam_name,site3)" in partition.group(2)
    files = {f for (f,) in part.select("_metadata.file_path").distinct().collect()}
    assert files and all("category=dominant_cover/year=2019/" in f for f in files)


@pytest.fixture
def whole_plans(spark):
    """Plans with their reused exchanges, which adaptive execution only finds while it runs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_panel_shuffles_images_once_and_is_stored_without_another(whole_plans, tmp_path, monkeypatch):
    """Neither unfolded rows nor sums and counts of every class are shuffled; rows and means read one exchange of images."""
    from fieldstate.operators import evaluate

    spark = whole_plans
    panel = evaluate.timeseries_panel(D.observations(spark, SF), catalog.final(spark, SF))
    plan = re.sub(r"#\d+", "", plan_of(panel))
    assert plan.count("- Exchange rangepartitioning(phenocam_name") == 1  # and a ReusedExchange of it
    assert "hashpartitioning(phenocam_name, year, date, file" not in plan
    frame = type(panel)
    for name in ("repartitionByRange", "repartition", "sortWithinPartitions"):
        monkeypatch.setattr(frame, name, lambda self, *a, _n=name: pytest.fail(f"{_n} of unfolded rows"))
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "3")
    evaluate.store_panel(panel, str(tmp_path / "panel"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "3"
    spark.conf.unset("spark.sql.maxConcurrentOutputFileWriters")


def test_cleaning_is_compiled_and_sorts_in_one_direction(whole_plans, capsys):
    """The JVM compiles no method above 8,000 bytes; next values come from the order of the values before."""
    prepared = catalog.prepared(whole_plans, SF)
    prepared.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000
    assert "DESC" not in plan_of(prepared)
    assert "DESC" not in plan_of(catalog.QUERIES["interpolate_gaps_long"](whole_plans, SF))


def test_long_decoding_packs_its_chunks_from_one_cleaned_series(whole_plans):
    plan = plan_of(catalog.QUERIES["viterbi_decode_long"](whole_plans, SF))
    assert len(re.findall(r"Generate explode\(sequence\(_from", plan)) == 1


def test_final_predictions_decode_once(whole_plans):
    plan = plan_of(catalog.QUERIES["final_predictions"](whole_plans, SF))
    assert plan.count("ArrowEvalPython") == 1


def test_votes_and_paths_only_go_back_to_the_site(whole_plans):
    plan = re.sub(r"#\d+", "", plan_of(catalog.final(whole_plans, SF)))
    sent = re.search(r"Exchange hashpartitioning\(phenocam_name, \d+\), REPARTITION_BY_COL.*\n.*?Project \[(.*)\]", plan).group(1)
    assert "days.probabilities ELSE" in sent and not re.search(r"(^|, )days(,|$)", sent)


@pytest.mark.parametrize("name", ("vote_crop_type", "unknown_rules", "vote_uniqueness_check", "final_predictions"))
def test_votes_and_states_read_one_cleaned_series(whole_plans, name):
    plan = plan_of(catalog.QUERIES[name](whole_plans, SF))
    assert len(re.findall(r"Generate explode\(sequence\(_from", plan)) == 1 and plan.count("ArrowEvalPython") == 1


def test_renormalisation_sums_outside_the_lambda(whole_plans):
    """A lambda function is interpreted for every element: it divides by a column and adds nothing up."""
    divided = re.findall(r"lambdafunction\(\((.*?), lambda ", plan_of(catalog.prepared(whole_plans, SF)))
    divided = [d for d in divided if " / " in d and "lambda p" in d]
    assert divided and all(" + " not in d and "_total_" in d for d in divided)


@pytest.mark.parametrize("name", ("hmm_failures", "field_states"))
def test_unfolded_images_are_sorted_only_where_they_are_dealt(whole_plans, name):
    """Images are made from narrow rows: the task that makes them passes them on unsorted."""
    plan = re.sub(r"#\d+", "", plan_of(catalog.QUERIES[name](whole_plans, SF)))
    dealt = plan.index("Exchange hashpartitioning(phenocam_name, date, ")
    assert "Sort [phenocam_name ASC" in plan[:dealt] and "Sort [" not in plan[dealt:]


@pytest.mark.parametrize("name", ("truth_table", "hmm_eval_set", "overall_metrics_final", "confusion_matrix_final", "coverage_check_final"))
def test_split_reads_one_exchange_of_its_images(whole_plans, name):
    """Both passes that find the cut-off, the rows and the copies of the cut-off row: joined and unfolded once, read four times."""
    plan = re.sub(r"#\d+L?", "", plan_of(catalog.QUERIES[name](whole_plans, SF)))
    dealt = "Exchange hashpartitioning(filename, phenocam_name, date, dominant_cover, crop_type, crop_status, "
    lines = [line for line in plan.split("\n") if dealt in line]
    made = [line for line in lines if "ReusedExchange" not in line]
    assert len(made) == 1 and len(lines) >= 4
    assert plan.count("FileScan parquet") <= 4  # images of final days, all images, annotated images


def test_final_days_are_joined_before_they_are_unfolded(whole_plans):
    """All days of all sites: one row each is shuffled to the annotated images, not one per category."""
    for name in ("hmm_eval_set", "confusion_matrix_final", "overall_metrics_final"):
        plan = plan_of(catalog.QUERIES[name](whole_plans, SF))
        assert "Generate inline" in plan  # the truth, by category
        assert "hmm_class, dominant_cover" not in plan and "output=[category, hmm_class]" not in re.sub(r"#\d+", "", plan)
        assert not re.search(r"Generate inline\(array\(struct\(category, dominant_cover, hmm_class", re.sub(r"#\d+", "", plan))
    plan = re.sub(r"#\d+", "", plan_of(catalog.QUERIES["coverage_check_final"](whole_plans, SF)))
    unfolded = plan.index("hmm_class, dominant_cover")
    assert "[phenocam_name, date], [phenocam_name, date], LeftSemi" in plan[unfolded:]


def test_file_names_of_images_are_not_made_for_every_row(whole_plans):
    """A filter on the date in the name stays above the aggregate that unites shots."""
    plan = plan_of(catalog.prepared(whole_plans, SF))
    below = plan[plan.index("partial_min"):]
    assert "gettimestamp" not in below and "date_format" not in below
