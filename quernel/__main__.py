"""python -m quernel index|search|ask|lint ROOT STORE [TEXT]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine


def main() -> None:
    p = argparse.ArgumentParser(prog="quernel")
    p.add_argument("command", choices=["index", "search", "ask", "lint"])
    p.add_argument("root")
    p.add_argument("store")
    p.add_argument("text", nargs="?", default="")
    a = p.parse_args()
    spark = SparkSession.builder.appName("quernel").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, a.root, a.store)
    asked = spark.createDataFrame([(1, a.text)], "query_id long, text string")
    if a.command == "index":
        engine.index().show(truncate=False)
    elif a.command == "search":
        engine.search(asked).orderBy("rank").show(truncate=False)
    elif a.command == "ask":
        engine.ask(asked).show(truncate=False, vertical=True)
    else:
        docs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{a.root}/docs")
        docs = docs.select("path", F.element_at(F.split("path", "/"), -1).alias("basename"), F.col("content").cast("string").alias("content"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"))
        print(engine.report(docs))


if __name__ == "__main__":
    main()
