"""Every registered query of the trace engine against SQL, and those without SQL for their properties."""

import pytest
from oracle import duck, same

from tracemill.operators import decode, domains
from tracemill.plans import adapters, catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, name):
    same(catalog.QUERIES[name](spark, SF), catalog.ORACLE[name], duck(SF))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_greedy_uses_a_spot_once_and_leaves_no_free_pair(spark):
    pairs = catalog._candidates(spark, SF)
    groups = decode.scored(pairs, ["cell_id"], ["height"], ["variation", "distance"])
    taken = decode.greedy(groups, ["cell_id"]).collect()
    used = [x for r in taken for x in (r.a, r.b)]
    assert len(used) == len(set(used))
    assert all(r.a in used or r.b in used for r in pairs.collect())


def test_iterative_pick_gives_each_spot_to_one_copy(spark):
    picked = catalog.iterative_pick(spark, SF).collect()
    assert picked and len({r.uid for r in picked}) == len(picked)
    assert len({(r.cell_id, r.chr, r.region, r.copy) for r in picked}) == len(picked)


def test_dynamic_pick_takes_one_spot_a_region(spark):
    picked = catalog.dynamic_pick(spark, SF).collect()
    spots = adapters.spots(spark, SF).select("cell_id", "region").distinct().count()
    assert len(picked) == spots


def test_placed_probes_keep_their_distance(spark):
    rows = catalog.placed_probes(spark, SF).orderBy("uid", "start").collect()
    assert rows and all(a.uid != b.uid or b.start - a.start >= 32 for a, b in zip(rows, rows[1:], strict=False))


def test_domains_tile_each_copy(spark):
    by = {}
    for r in domains.called(adapters.traces(spark, SF), ["copy"]).collect():
        by.setdefault(r.copy, []).append((r.start, r.end))
    assert by and all(x == 0 if k == 0 else x == sorted(v)[k - 1][1] for v in by.values() for k, (x, _) in enumerate(sorted(v)))
