"""Queries on tables without rows: none crashes, and what SQL defines is the same."""

import duckdb
import pyarrow.parquet as pq
import pytest

from locusframe.plans import catalog
from tests.compare import rows
from tests.test_catalog import SF, TABLES

#: Where the operator defines more than SQL does for no rows: a gate that is closed, a share of 0, no row instead of a row of nulls.
OWN = {"w10_pair_gate", "e2_merge_predictions", "e6_interval_calibration", "j14_duplication_audit", "h7_set_contrast", "t3_ndcg", "t9_bootstrap_median", "t10_bootstrap_auc", "t17_matched_auc_null", "t17_matched_auc",
       "t19_residual_spearman", "k5_shard_manifest", "r7_floors_report", "q15_score_summary"}
SOME = ("n3_pagerank", "s6_read_wide_matrix", "s12_read_manifests", "k1_write_windows", "k5_shard_manifest", "t25_cv_auc", "t26_permutation_importance", "t27_regressor", "g1_offtargets", "j6_merge_intervals", "j10_coverage_runs",
        "j13_spaced_topk", "t1_avg_rank", "t3_auroc", "t5_bh_fdr", "t6_permutation_p", "t21_selection_aware_p", "t22_set_permutation", "h8_caliper_match", "h9_residual_sweep", "h9_caliper_sweep", "h10_leave_one_out", "r2_dominance",
        "r3_pareto_fronts", "r4_crowding", "r6_front_membership", "n1_coexpression_edges", "st1_stream_once_per_id", "m13_feature_matrix", "e12_stability_audit", "q10_melting_temp", "q23_nn_identity", "t17_matched_auc_null", "t10_bootstrap_auc")


@pytest.fixture(scope="module")
def empty_tables(tmp_path_factory):
    where = str(tmp_path_factory.mktemp("empty"))
    con = duckdb.connect()
    for t in TABLES:
        pq.write_table(pq.read_table(f"{SF}/{t}.parquet").slice(0, 0), f"{where}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{where}/{t}.parquet'")
    return where, con


@pytest.mark.parametrize("name", SOME)
def test_no_rows(spark, empty_tables, name):
    where, con = empty_tables
    got = catalog.QUERIES[name](spark, where).toPandas()
    if name in catalog.SQL and name not in OWN:
        assert rows(got) == rows(con.execute(catalog.SQL[name]).df())
