from antecede.checks import load

FOLDER = "/root/testdata/sf0.01"


def test_expansion_query_follows_five_candidates_over_three_levels(spark):
    rows = load()["j20_expansion_levels"][0](spark, FOLDER).collect()
    levels = {n: [r for r in rows if r.depth == n] for n in {r.depth for r in rows}}
    assert set(levels) == {1, 2, 3}
    for n in (1, 2):
        followed = {r.rep_id for r in levels[n] if r.rank is not None and r.rank <= 5}
        assert followed <= {r.target_id for m in range(1, n + 2) for r in levels[m]}
