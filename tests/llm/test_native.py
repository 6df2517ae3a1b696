from collections import Counter

from wayfarer.llm import exact_dedup, mixing


def expected(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    return groups


def test_exact_groups_with_heavy_hitters(documents_of):
    rows = [(i, "hot") for i in range(0, 400, 2)] + [(i, f"t{i // 3}") for i in range(1001, 1100)]
    rows += [(5000, None), (5001, ""), (None, "hot"), (398, "hot"), (None, "alone")]
    docs = documents_of(rows).withColumnRenamed("lang", "heavy_keep")
    for support in (0.3, 0.001):
        got = exact_dedup.exact_groups(docs, support=support).collect()
        groups = expected(rows)
        assert len(got) == len(rows)
        by = {}
        for x in got:
            by.setdefault(x.text_sha256, []).append(x)
        assert len(by) == len(groups)
        for found in by.values():
            assert sum(x.kept for x in found) == 1 and {x.group_size for x in found} == {len(found)}
            ids = [x.doc_id for x in found if x.doc_id is not None]
            assert {x.keep_id for x in found} == {max(ids, default=None)}
            assert [x.doc_id for x in found if x.kept] == [max(ids, default=None)]
        kept = exact_dedup.drop_exact_copies(docs, support=support)
        assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


def test_mixing_rates_and_edges(documents_of):
    rows = [(i, "x", "big") for i in range(3000)] + [(i, None, "small") for i in range(5000, 5300)] + [(9000, "n", None)] * 2
    docs = documents_of(rows).withColumnRenamed("lang", "copy")
    got = mixing.mix_sources(docs, weights={"big": 1, "small": 3}).collect()
    n = Counter(x.source for x in got)
    assert set(n) == {"big", "small"}
    assert abs(n["big"] - 825) < 150 and abs(n["small"] - 2476) < 250
    groups = Counter((x.doc_id, x.n_copies) for x in got)
    assert all(k == c for (_, k), c in groups.items())
    assert {x.copy for x in got if x.doc_id == got[0].doc_id} == set(range(got[0].n_copies))
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs, weights={}).count() == 0


def test_mixing_large_rates(documents_of):
    docs = documents_of([(1, "a", "one"), *[(i, "b", "rest") for i in range(2, 4000)]])
    got = mixing.mix_sources(docs).groupBy("source").count().collect()
    assert {x["source"]: abs(x["count"] - 2000) < 250 for x in got} == {"one": True, "rest": True}


def test_rare_sources_give_the_rows_of_the_sql(spark, documents_of, tmp_path):
    import duckdb

    from wayfarer.llm.queries import OP9_SQL, op9_mix_sources

    rows = [(i, f"t{i}", ("a", "b", "c")[i % 3]) for i in range(9000)]
    rows += [(9000 + i, f"t{i}", "rare") for i in range(3)] + [(9100 + i, "x", "some") for i in range(4)] + [(9200, "n", None)]
    documents_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "text", "lang", "source", "n_chars", "n_copies", "copy", "shuffle_key"]
    got = sorted((tuple(x[c] for c in names) for x in op9_mix_sources(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"select {', '.join(names)} from ({OP9_SQL})").fetchall(), key=str)
    assert got == want
    assert {x[3]: x[5] for x in got}[None] > mixing.TABLE_MOST


def test_large_rates_are_inverted(spark):
    import math

    rates = [513.0, 1000.5, 14286.7, 250000.25]
    us = [2.0**-52, 1e-9, 0.01, 0.25, 0.5, 0.75, 0.99, 1 - 1e-9]

    def poisson(rate, u):
        k, c = max(0, int(rate - 14 * math.sqrt(rate))), 0.0
        terms = []
        while not terms or k <= rate + 14 * math.sqrt(rate):
            terms.append(math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)))
            k += 1
        for n, p in enumerate(terms):
            c += p
            if c > u:
                return k - len(terms) + n
        return k

    table = spark.createDataFrame([(r, u) for r in rates for u in us], "rate double, u double")
    for x in table.selectExpr("rate", "u", f"{mixing._inverted('rate', 'u')} as n").collect():
        slack = 0 if 1e-9 < x.u < 0.995 else math.sqrt(x.rate) / 4  # sums at the ends depend on rounding
        assert abs(x.n - poisson(x.rate, x.u)) <= slack


def test_mixing_keeps_columns_of_any_name(spark, documents_of):
    names = ["rate", "cdf", "mix_source", "mix_u", "mix_block", "row", "id", "u", "block", "n", "top", "a.b", "N_Copies"]
    docs = documents_of([(i, f"t{i}", ("a", None)[i % 2]) for i in range(50)] + [(None, "x", "a"), (None, "y", "a"), (3, "t3", None)])
    docs = docs.selectExpr("*", *[f"doc_id as `{c}`" for c in names])
    got = mixing.mix_sources(docs)
    assert got.columns == [c for c in docs.columns if c != "N_Copies"] + ["n_copies", "copy", "shuffle_key"]
    rows = got.collect()
    assert rows and all(x[c] == x.doc_id for x in rows for c in names[:-1])
    whole = mixing.replicated(docs)
    assert whole.columns == docs.columns and whole.count() == len(rows)
    assert Counter(x.doc_id for x in whole.collect()) == Counter(x.doc_id for x in rows)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_exact_groups_of_many_equal_rows(documents_of):
    rows = [(7, "same")] * 40 + [(None, "same")] * 25 + [(i, "other") for i in range(30)] + [(29, "other")] * 3
    for support in (0.5, 0.01):
        got = exact_dedup.exact_groups(documents_of(rows), support=support).collect()
        assert len(got) == len(rows)
        assert Counter((x.doc_id, x.keep_id, x.group_size, x.kept) for x in got) == Counter(
            [(7, 7, 65, True)] + [(7, 7, 65, False)] * 39 + [(None, 7, 65, False)] * 25
            + [(i, 29, 33, False) for i in range(29)] + [(29, 29, 33, True)] + [(29, 29, 33, False)] * 3
        )
