"""What the driver plans at a time in the pipeline's first two stages."""

from quaymark.llm import quality, simhash
from quaymark.sources import shared


def test_pipeline_plans_stay_small(spark, edge_dir, monkeypatch):
    sizes, write = {}, shared.write_parquet

    def measured(df, path, *partition_by):
        name = path.rsplit("/", 1)[-1].rsplit("-", 1)[0]
        sizes[name] = max(sizes.get(name, 0), len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        write(df, path, *partition_by)

    monkeypatch.setattr(shared, "write_parquet", measured)
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    simhash.deduplicated(quality.kept(docs)).count()
    assert {"quality-sums", "components", "similar-prefixes"} <= set(sizes)
    assert {name: n for name, n in sizes.items() if n > 40} == {}
