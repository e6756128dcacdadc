"""Small catalogues for tests, in the shape of the product's input."""

from sievecraft.sources.schema import RAW_SCHEMA

# size, detections, scan date, market
TEN = [
    (10386469, "0", "2016-06-15 15:26:44", "anzhi"),
    (43545076, None, None, "play.google.com"),
    (3537486, "0", "2016-11-20 10:26:31", "PlayDrone"),
    (52469861, "0", "2021-03-17 08:02:21", "play.google.com"),
    (4300370, "0", "2017-12-03 06:50:28", "play.google.com"),
    (12958838, "0", "2019-06-25 08:55:42", "play.google.com"),
    (1044597, "1", "2014-04-27 06:30:31", "appchina"),
    (3161615, "0", "2020-07-13 07:37:27", "play.google.com"),
    (55999935, "0", "2024-10-08 05:49:17", "play.google.com"),
    (12634646, "0", "2025-02-10 07:11:19", "play.google.com"),
]


def row(key, size=1000, det="0", date="2023-01-01 00:00:00", market="play.google.com", name="com.example"):
    sha = None if key is None else f"{key:064X}" if isinstance(key, int) else key
    return (sha, "A" * 40, "B" * 32, "1980-01-01 00:00:00", size, name, 1, det, date, 500, market)


def catalog(spark, rows):
    return spark.createDataFrame(rows, RAW_SCHEMA)


def ten(spark):
    return catalog(spark, [row(i, *values) for i, values in enumerate(TEN, 1)])


def csv_text(rows):
    lines = [",".join(RAW_SCHEMA.fieldNames())]
    for r in rows:
        quoted = [f'"{v}"' if i == 5 else "" if v is None else str(v) for i, v in enumerate(r)]
        lines.append(",".join(quoted))
    return "\n".join(lines) + "\n"


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
