"""Fitting of the stored model: ``python -m skerry.llm.abuse_train FOLDER OUT.npz``, FOLDER with documents and labels."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from skerry.llm.abuse import fit_documents


def main(folder: str, target: str) -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.driver.memory", "8g").getOrCreate()
    model = fit_documents(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    model.save(target)
    print(len(model.at), "weights")


if __name__ == "__main__":
    main(*sys.argv[1:])
