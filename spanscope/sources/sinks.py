"""Where results go: CSV, LaTeX."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` gives one file, for small reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def latex(df: DataFrame, caption: str = "", rows: int = 1000) -> str:
    """A LaTeX table of a report; raises ValueError beyond ``rows``, since a report is small."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a report has at most {rows} rows")
    escape = lambda v: "n/a" if v is None else str(v).replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&").replace("#", r"\#")
    body = "".join(" & ".join(map(escape, r)) + " \\\\\n" for r in got)
    head = " & ".join(map(escape, df.columns))
    return f"\\begin{{table}}\n\\caption{{{escape(caption)}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n\\hline\n{head} \\\\\n\\hline\n{body}\\hline\n\\end{{tabular}}\n\\end{{table}}\n"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder all executors share; a temporary one only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spanscope-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to a new shared folder and read back: computed once, however often it is used."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
