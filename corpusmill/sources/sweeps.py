"""Published sweep results as DataFrames, and the parser of sweep tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Published results. Columns: compute, d_model, layers, heads, d_ff, tokens in millions, learning rate, parameters in
# millions (as published), note, loss, validation perplexity. "-" where the publication has none.
# First sweep: one learning rate for all.
FIRST = """
5e14  256  6  8  1024  18  1.2e-3  -  -  5.106007  169.0815
5e14  256  4  8  1024  27  1.2e-3  -  -  5.017829  151.0021
5e14  192  4  6  768  47  1.2e-3  -  -  4.878770  135.8031
5e14  160  4  4  640  68  1.2e-3  -  -  4.887997  127.9556
5e14  128  4  4  512  106  1.2e-3  -  -  4.728893  114.9802
5e14  96  4  3  384  189  1.2e-3  -  -  4.606339  105.2848
5e14  96  3  3  384  252  1.2e-3  -  -  4.658407  105.1166
5e14  64  4  4  256  544  1.2e-3  -  -  4.603931  99.2108
1e15  384  4  6  1536  23  1.2e-3  -  -  4.946815  136.6372
1e15  256  6  8  1024  35  1.2e-3  -  -  4.758970  125.2796
1e15  256  4  8  1024  53  1.2e-3  -  -  4.756914  112.9351
1e15  192  6  6  768  63  1.2e-3  -  -  4.609312  106.5247
1e15  192  4  6  768  94  1.2e-3  -  -  4.521452  100.1243
1e15  160  4  4  640  135  1.2e-3  -  -  4.398637  88.0812
1e15  128  4  4  512  212  1.2e-3  -  -  4.402515  81.9017
1e15  96  4  3  384  377  1.2e-3  -  -  4.368236  82.6243
1e15  96  3  3  384  503  1.2e-3  -  -  4.239828  79.3390
5e15  512  8  8  2048  33  1.2e-3  -  -  4.494258  89.3551
5e15  512  6  8  2048  44  1.2e-3  -  -  4.356299  71.2789
5e15  384  6  6  1536  79  1.2e-3  -  -  3.854547  47.4915
5e15  384  4  6  1536  118  1.2e-3  -  -  3.718233  42.6782
5e15  256  6  8  1024  177  1.2e-3  -  -  3.711673  40.1712
5e15  256  4  8  1024  265  1.2e-3  -  -  3.558712  40.2278
5e15  192  6  6  768  314  1.2e-3  -  -  3.522850  38.3601
5e15  160  6  4  640  452  1.2e-3  -  -  3.653570  41.1945
5e15  128  6  4  512  706  1.2e-3  -  -  3.707397  40.9666
5e15  128  4  4  512  1060  1.2e-3  -  -  3.714916  42.6294
5e15  96  5  3  384  1506  1.2e-3  -  -  3.869177  46.6166
"""
# Learning-rate sweeps of three models.
RATES = """
-  512  8  8  2048  33  8.0e-4  -  -  4.595140  99.6052
-  512  8  8  2048  33  1.2e-3  -  -  4.439963  85.1542
-  512  8  8  2048  33  1.6e-3  -  -  4.332994  80.0178
-  512  8  8  2048  33  2.0e-3  -  -  4.386354  84.1576
-  512  8  8  2048  33  3.0e-3  -  -  4.644372  108.8702
-  512  8  8  2048  33  4.0e-3  -  -  5.078491  164.2576
-  512  8  8  2048  33  5.0e-3  -  -  5.429850  233.6550
-  512  8  8  2048  33  6.0e-3  -  -  5.436263  239.8608
-  256  4  8  1024  53  1.5e-3  -  -  4.612030  103.2723
-  256  4  8  1024  53  2.0e-3  -  -  4.525163  93.2636
-  256  4  8  1024  53  2.5e-3  -  -  4.422519  84.3768
-  256  4  8  1024  53  3.0e-3  -  -  4.430634  80.6603
-  256  4  8  1024  53  4.0e-3  -  -  4.374244  79.9662
-  256  4  8  1024  53  5.0e-3  -  -  4.384834  83.0857
-  256  4  8  1024  53  6.0e-3  -  -  4.422269  81.8793
-  256  4  8  1024  53  7.0e-3  -  -  4.492009  89.0020
-  256  4  8  1024  53  8.0e-3  -  -  4.508808  93.4934
-  96  5  3  384  1506  2.5e-3  -  -  3.745512  43.3032
-  96  5  3  384  1506  3.5e-3  -  -  3.632446  40.6195
-  96  5  3  384  1506  4.5e-3  -  -  3.553415  38.9876
-  96  5  3  384  1506  5.5e-3  -  -  3.537445  39.6173
-  96  5  3  384  1506  7.5e-3  -  -  3.724095  39.3263
-  96  5  3  384  1506  9.5e-3  -  -  3.663815  38.7232
"""
# Second sweep: calibrated learning rates.
CALIBRATED = """
5e15  512  8  8  2048  33  1.6e-3  25.2  anchor  4.435  84.29
5e15  512  6  8  2048  44  1.8e-3  18.9  -  4.100  63.74
5e15  384  6  6  1536  79  2.5e-3  10.6  -  3.733  40.80
5e15  384  4  6  1536  118  3.0e-3  7.08  -  3.610  35.99
5e15  256  6  8  1024  177  3.5e-3  4.72  -  3.550  32.89
5e15  256  4  8  1024  265  4.0e-3  3.14  anchor  3.381  32.63
5e15  192  6  6  768  314  4.1e-3  2.65  -  3.486  32.50
5e15  160  6  4  640  452  4.2e-3  1.84  -  3.434  34.45
5e15  128  6  4  512  706  4.3e-3  1.18  -  3.522  35.94
5e15  128  4  4  512  1060  4.4e-3  0.79  -  3.494  37.73
5e15  96  5  3  384  1506  4.5e-3  0.55  anchor  3.690  41.75
1e15  384  4  6  1536  23  3.0e-3  7.08  -  4.900  142.99
1e15  256  6  8  1024  35  3.5e-3  4.72  -  4.543  98.76
1e15  256  4  8  1024  53  4.0e-3  3.14  anchor  4.379  84.49
1e15  192  6  6  768  63  4.1e-3  2.65  -  4.284  72.39
1e15  192  4  6  768  94  4.2e-3  1.77  -  4.060  58.99
1e15  160  4  4  640  135  4.3e-3  1.23  -  3.893  50.22
1e15  128  4  4  512  212  4.4e-3  0.79  -  3.831  47.82
1e15  96  4  3  384  377  4.6e-3  0.44  -  3.872  49.41
1e15  96  3  3  384  503  4.7e-3  0.33  -  3.988  53.10
5e14  256  6  8  1024  18  3.5e-3  4.72  -  5.129  176.08
5e14  256  4  8  1024  27  4.0e-3  3.14  anchor  4.881  132.30
5e14  192  4  6  768  47  4.2e-3  1.77  -  4.677  99.00
5e14  160  4  4  640  68  4.3e-3  1.23  -  4.432  86.85
5e14  128  4  4  512  106  4.4e-3  0.79  -  4.254  68.08
5e14  96  4  3  384  189  4.6e-3  0.44  -  4.136  65.13
5e14  96  3  3  384  252  4.7e-3  0.33  -  4.200  72.25
5e14  64  4  4  256  544  4.8e-3  0.15  -  4.150  67.74
5e14  48  4  4  192  753  5.0e-3  0.11  -  4.430  82.52
5e14  40  4  4  160  1085  5.1e-3  0.08  -  4.459  89.70
5e14  32  4  4  128  1695  5.2e-3  0.05  -  4.703  101.40
"""

COLUMNS = ("c", "d", "l", "h", "ff", "tokens_m", "lr", "n_published_m", "note", "loss", "val_ppl")
DDL = "c double, d int, l int, h int, ff int, tokens_m double, lr double, n_published_m double, note string, loss double, val_ppl double"


def rows(text: str) -> list[tuple]:
    """Typed rows of one of the tables above."""
    kinds = (float, int, int, int, int, float, float, float, str, float, float)
    return [tuple(None if v == "-" else kind(v) for kind, v in zip(kinds, line.split())) for line in text.strip().splitlines()]


def sweep(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(rows(text), DDL)


def values_sql(text: str) -> str:
    """The same table as SQL VALUES."""
    shown = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else repr(v)
    lines = ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows(text))
    return f"(SELECT * FROM (VALUES {lines}) AS t({', '.join(COLUMNS)}))"


def parse_configs(lines: DataFrame) -> DataFrame:
    """d, l, h, ff, tokens, lr of `lines` (value): quoted, blank-separated rows of four fields (no tokens, no rate) or six."""
    f = F.split(F.trim(F.regexp_extract("value", r'"([^"]+)"', 1)), r"\s+")
    found = lines.where(F.col("value").rlike(r'^\s*"[^"]+"')).select(f.alias("f"))
    at = lambda i, kind: F.get("f", F.lit(i)).cast(kind)
    return found.where(F.size("f").isin(4, 6)).select(at(0, "int").alias("d"), at(1, "int").alias("l"), at(2, "int").alias("h"), at(3, "int").alias("ff"), at(4, "long").alias("tokens"), at(5, "double").alias("lr"))


def parse_results(lines: DataFrame) -> DataFrame:
    """section, d, l, h, ff, tokens, lr, loss, val_ppl of `lines` (pos, value): quoted rows of 7 fields, or 8 with the rate; the
    section is the last heading (a line that begins with #) before them."""
    heading = F.when(F.col("value").startswith("#"), F.trim(F.regexp_replace("value", r"^#+", "")))
    filled = lines.withColumn("section", F.last(heading, ignorenulls=True).over(Window.orderBy("pos")))  # one small file
    f = F.split(F.trim(F.regexp_extract("value", r'"([^"]+)"', 1)), r"\s+")
    found = filled.where(F.col("value").rlike(r'^\s*"[^"]+"')).withColumn("f", f).where(F.size("f").isin(7, 8))
    at = lambda i, kind: F.get("f", i if not isinstance(i, int) else F.lit(i)).cast(kind)
    n = F.size("f")
    return found.select("section", at(0, "int").alias("d"), at(1, "int").alias("l"), at(2, "int").alias("h"), at(3, "int").alias("ff"), at(4, "long").alias("tokens"), F.when(n == 8, at(5, "double")).alias("lr"), at(n - 2, "double").alias("loss"), at(n - 1, "double").alias("val_ppl"))
