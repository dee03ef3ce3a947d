"""The engine's functions in SQL: scalar functions and table functions for LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from quillrow.operators import doubled, numberformats, statutes
from quillrow.session import ship


def register(spark: SparkSession) -> None:
    """Registers doubled_runs, roman_number, format_loss, md_tables and provision_chain."""
    ship(spark)
    @pandas_udf("array<string>")
    def doubled_runs(texts: pd.Series) -> pd.Series:
        return texts.map(doubled.greedy)

    @pandas_udf("int")
    def roman_number(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: statutes.roman(t) if t else None).astype("Int32")

    @pandas_udf("struct<hidden:boolean,misrendered:boolean>")
    def format_loss(ids: pd.Series, codes: pd.Series, values: pd.Series) -> pd.DataFrame:
        rows = [numberformats.loss(int(i), c, None if pd.isna(v) else float(v)) for i, c, v in zip(ids, codes, values, strict=True)]
        return pd.DataFrame(rows, columns=["hidden", "misrendered"])

    @udtf(returnType="row int, col int, cell string")
    class MdTables:
        def eval(self, markdown: str) -> Iterator[tuple[int, int, str]]:
            import re

            n = 0
            for line in (markdown or "").splitlines():
                t = line.strip()
                if len(t) < 2 or t[0] != "|" or t[-1] != "|" or (re.fullmatch(r"[|:\- ]+", t) and "-" in t):
                    continue
                for c, cell in enumerate(re.split(r"(?<!\\)\|", t[1:-1])):
                    yield n, c, cell.strip()
                n += 1

    @udtf(returnType="label string, title string, body string")
    class ProvisionChain:
        def eval(self, line: str) -> Iterator[tuple[str, str | None, str]]:
            made = statutes.chain((line or "").strip(), False, False)
            if made:
                for i, label in enumerate(made[0]):
                    yield label, (made[1] or None) if i == len(made[0]) - 1 else None, made[2]

    spark.udf.register("doubled_runs", doubled_runs)
    spark.udf.register("roman_number", roman_number)
    spark.udf.register("format_loss", format_loss)
    spark.udtf.register("md_tables", MdTables)
    spark.udtf.register("provision_chain", ProvisionChain)
