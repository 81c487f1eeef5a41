"""The registry: names, oracles, and every query next to DuckDB on the smallest tables."""

import random

import pytest

import __spark_entry__ as entry
import checks
from checks import compare
from lumicat.operators import policy
from tests.llm.common import joined_rows

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(checks.ORACLE) == set(checks.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(checks.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


# one query per family here; ``python -m checks.compare`` runs them all
FAMILIES = (
    "j4_images_by_tag j10_post_previews k3_suggest_tags k6_suggest v3_knn_by_ids v4_top_tags r2_random_posts m1_merge_names "
    "m2_merge_images m15_apply_like_log c14_pseudonym c25_decode_price q5_convertible b1_match_transfers b5_quote_deposits "
    "j17_policy_candidates h1_classify_requests h2_classify_object_events a15_phase_occupancy p5_plan_conversions"
).split()


@pytest.mark.parametrize("name", FAMILIES)
def test_oracle(spark, name):
    con = compare.duck(SF)
    text, ok, _ = compare.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


def test_no_plan_has_a_cartesian_product(spark):
    for name in FAMILIES:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_scans_are_narrow(spark):
    """A search by vector reads the id and the vector, filters reach the scan."""
    plan = entry.queries()["v1_knn"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
    plan = entry.queries()["m19_delete_cascade"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,40)" in plan


def test_top_n_per_key_is_cut_before_the_shuffle(spark):
    plan = entry.queries()["j22_payment_history"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_first_publication_stores_the_initial_document(spark):
    revs = spark.createDataFrame([(0, "{}", 0, None)], "revision int, document string, updated_at bigint, updated_by string")
    drafts = spark.createDataFrame([(0, "B", 9, "late"), (0, "A", 5, "early"), (1, "C", 6, "stale")],
                                   "base_revision int, document string, updated_at bigint, updated_by string")
    once = policy.publish_revision(revs, drafts, "initial")
    assert sorted((r.revision, r.document) for r in once.collect()) == [(0, "initial"), (1, "A")]
    again = policy.publish_revision(once, drafts.where("base_revision = 0"))
    assert again.count() == 2


def test_asof_with_revisions_out_of_order(spark):
    revs = spark.createDataFrame([(0, "a", 0), (1, "b", 500_000), (2, "c", 400_000), (3, "d", 500_000)],
                                 "revision int, document string, updated_at bigint")
    times = [-1, 0, 399_999, 400_000, 499_999, 500_000, 10**9]
    events = spark.createDataFrame([(t,) for t in times], "ts bigint")
    got = {r.ts: r.revision for r in policy.policy_asof(events, revs).collect()}
    want = {t: max(r for r, u in ((0, 0), (1, 500_000), (2, 400_000), (3, 500_000)) if u <= t) for t in times if t >= 0}
    assert got == want


def plain_candidates(revs, t):
    """J17 by its definition: (revision, u) pairs and one time."""
    known = [r for r, u in revs if u <= t]
    if not known:
        return {}
    active, floor_at = max(known), max(t - 900, 0)
    ahead = sorted(r for r, u in revs if t < u <= t + 120)[:5]
    back = []
    if any(r == active and u >= floor_at for r, u in revs) and active > 0:
        before = [r for r, u in revs if u < floor_at]
        slot_end = (t // 900 + 1) * 900
        back = {r for r, u in revs if r < active and floor_at <= u < slot_end} | {r for r in ([max(before)] if before else []) if r < active}
        back = sorted(back, reverse=True)[:5]
    out = {}
    for p, r in [(0, active), *enumerate(ahead, 1), *enumerate(back, 6)]:
        out[r] = min(p, out.get(r, p))
    return out


def test_candidates_by_definition(spark):
    rng = random.Random(5)
    ordered = [(i, 200 + 37 * i + rng.randrange(37)) for i in range(120)]
    mixed = [(r, rng.randrange(6_000)) for r in rng.sample(range(400), 150)]  # published out of order, at equal times too
    times = [0, 1, 119, 120, 899, 900, 901, *(rng.randrange(7_000) for _ in range(150))]
    for revs in (ordered, mixed, [(0, 50)]):
        rows = spark.createDataFrame([(r, "{}", u) for r, u in revs], "revision int, document string, updated_at bigint")
        events = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "event_id int, ts bigint")
        got = {}
        for row in policy.policy_candidates(events, rows).collect():
            got.setdefault(row.event_id, {})[row.revision] = row.priority
        assert got == {i: want for i, t in enumerate(times) if (want := plain_candidates(revs, t))}


def test_candidates_do_not_pair_all_times_with_all_revisions(spark):
    """A dense quarter of an hour: each time brings at most ten rows a side, whatever the number of revisions."""
    revs = spark.range(3_600).selectExpr("cast(id AS int) AS revision", "'{}' AS document", "9000 + id div 4 AS updated_at")
    events = spark.range(900).selectExpr("id AS event_id", "9000 + id AS ts")
    found = policy.policy_candidates(events, revs)
    assert len(found.collect()) <= 900 * 11
    assert joined_rows(found._jdf.queryExecution().executedPlan()) < 900 * 100
