import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def canon(df):
    """Rows in order of value, columns by name, floats to eight digits."""
    df = df[sorted(df.columns)].copy()
    for x in df.columns:
        if str(df[x].dtype).startswith("datetime"):
            df[x] = df[x].astype("datetime64[us]").astype(str)
        df[x] = df[x].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else round(v, 8) if isinstance(v, float) else v).astype(object)
    return sorted(map(repr, df.itertuples(index=False, name=None)))


def one(spark, value, expr):
    """The value of an expression over one string column t."""
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first()["x"]
