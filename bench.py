"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from embedspark.plans import catalog
from embedspark.session import local_session

# Query -> the table whose rows it works through, for rows per second.
HEADLINE = {
    "t3_token_count": "documents",
    "t4_text_encode": "documents",
    "t10_batch_embed": "conversations",
    "t15_batch_padding": "conversations",
    "v8_v9_variant_summary": "embeddings",
    "v11_interference": "embeddings",
    "v20_topk_neighbors": "documents",
    "v19_cross_modal_topk": "embeddings",
    "c12_dominant_color": "part",
    "c14_c16_image_color_stats": "part",
    "c17_exif_extract": "part",
    "d11_d15_success_review": "part",
    "i8_vision_encode": "part",
    "s10_s11_decode_pixels": "part",
    "b1_endpoint_summary": "events",
    "b2_b3_batch_size_summary": "events",
    "b7_early_stop": "events",
    "x1_stream_embedding": "documents",
    "x3_windowed_session": "events",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds, rates = {}, {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        if name in HEADLINE:
            rows = spark.read.parquet(f"{sf_dir}/{HEADLINE[name]}.parquet").count()
            rates[name] = round(rows / seconds[name], 1)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
