from listenloom.llm import match

DATA = "/root/testdata/sf0.001"


def test_forms_spelled_out_are_joined_by_shuffles(spark, monkeypatch):
    """Spark takes exploded forms for as few as their names and would send them through the driver."""
    plans, real = [], match.materialize

    def kept(df, *args, **kw):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *args, **kw)

    monkeypatch.setattr(match, "materialize", kept)
    match.match_recordings(spark.read.parquet(f"{DATA}/ext_tracks.parquet"), spark.read.parquet(f"{DATA}/track_catalog.parquet"))
    joins = [x for p in plans for x in p.splitlines() if "Join Inner" in x and "form#" in x]
    assert len(joins) >= 5 and all("strategy=merge" in x for x in joins)
