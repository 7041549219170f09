"""URL rules by a sorted array of 64-bit digests.

The rules' strings are hashed by xxhash64 into a sorted array, written once to the shared folder, handed to
executors as a Spark file and memory-mapped there; a long list becomes several arrays, dealt by digest. A batch of urls makes its candidate keys, probes them by one
vectorised binary search, and confirms every hit against the stored full string, so a collision costs time only.

Cases: a null url, or one without "://", has an empty host and path and no rule; a rule listed twice keeps its
last verdict; of rules of one length the one with the longer path wins; repeated rows and null ids are judged row by row; an empty rule list gives the default verdict; only the key and url columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import field_ddl, shared_dir, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Verdict of the method itself for an url of which no key is in the array.
DEFAULT = "allow"
#: An array is built in the driver's memory, so one holds about this many rules; more of them make several arrays.
MAX_RULES = 20_000_000

URL = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    found = URL.match(url or "")
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The file: three counts, the sorted digests, string ends, string bytes, verdicts, then the shapes of keys.

    Shapes: how many labels and how many path characters rules have; only such candidates are ever probed."""
    import numpy as np
    import xxhash

    of = {host.translate(UPPER) + path: (verdict, host.count(".") + 1, len(path)) for verdict, host, path in rules}
    order = sorted(of, key=lambda s: (xxhash.xxh64_intdigest(s), s))
    strings = [s.encode() for s in order]
    shapes = np.array(sorted({of[s][1:] for s in order}), "<u4").reshape(-1, 2)
    return b"".join([
        np.array([len(order), len(shapes), sum(map(len, strings))], "<u8").tobytes(),
        np.array([xxhash.xxh64_intdigest(s) for s in order], "<u8").tobytes(),
        np.cumsum([0, *map(len, strings)]).astype("<u8").tobytes(),
        shapes.tobytes(),
        b"".join(strings),
        bytes(of[s][0] == "block" for s in order),
    ])


def dealt(rules: Iterable[tuple[str, str, str]], most: int | None = None) -> Iterator[list[tuple[str, str, str]]]:
    """The rules in parts of about `most` (MAX_RULES), by a digest of their string, so that a repeated rule stays in one part."""
    import xxhash

    rules = list(rules)
    parts: list[list] = [[] for _ in range(max(1, -(-len(rules) // (most or MAX_RULES))))]
    for rule in rules:
        parts[xxhash.xxh3_64_intdigest(rule[1].translate(UPPER) + rule[2]) % len(parts)].append(rule)
    yield from parts


class DigestArray:
    def __init__(self, path: str):
        import numpy as np

        n, shapes, size = map(int, np.memmap(path, "<u8", "r", 0, (3,)))
        self.n, at = n, 24
        self.keys = np.memmap(path, "<u8", "r", at, (n,)) if n else np.empty(0, "<u8")
        self.ends = np.memmap(path, "<u8", "r", at := at + 8 * n, (n + 1,))
        self.shapes = np.memmap(path, "<u4", "r", at := at + 8 * (n + 1), (shapes, 2)).tolist() if n else []
        self.strings = np.memmap(path, "u1", "r", at := at + 8 * shapes, (size,)) if n else np.empty(0, "u1")
        self.blocks = np.memmap(path, "u1", "r", at + size, (n,)) if n else np.empty(0, "u1")

    def string(self, k: int) -> str:
        return self.strings[int(self.ends[k]) : int(self.ends[k + 1])].tobytes().decode()

    def candidates(self, host: str, path: str) -> Iterator[str]:
        ends = [k for k in range(len(host)) if host[k] == "."]
        for labels, chars in self.shapes:
            if labels <= len(ends) + 1 and chars <= len(path):
                yield (host if labels == len(ends) + 1 else host[ends[-labels] + 1 :]) + path[:chars]

    def judge(self, hosts: list[str], paths: list[str], default: str = DEFAULT) -> tuple[list[str | None], list[str]]:
        """Rule and verdict of each url; the longest rule wins."""
        import numpy as np
        import xxhash

        probes = [(k, s) for k, (h, p) in enumerate(zip(hosts, paths)) if h for s in self.candidates(h, p)]
        keys = np.fromiter((xxhash.xxh64_intdigest(s) for _, s in probes), "<u8", len(probes))
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        rules: list[str | None] = [None] * len(hosts)
        verdicts = [default] * len(hosts)
        for at in np.flatnonzero(hi > lo).tolist():
            k, s = probes[at]
            if rules[k] is not None and len(rules[k]) >= len(s):
                continue
            for slot in range(int(lo[at]), int(hi[at])):
                if self.string(slot) == s:
                    rules[k], verdicts[k] = s, "block" if self.blocks[slot] else "allow"
        return rules, verdicts


def longest(judged: list[tuple[list[str | None], list[str]]]) -> tuple[list[str | None], list[str]]:
    """Of what several arrays say of each url the longest rule, with its verdict."""
    size = lambda rule: (len(rule), -rule.split("/")[0].count(".")) if rule else (0, 0)
    best = [max(range(len(judged)), key=lambda a: size(judged[a][0][k])) for k in range(len(judged[0][0]))]  # noqa: B023
    return [judged[a][0][k] for k, a in enumerate(best)], [judged[a][1][k] for k, a in enumerate(best)]


def publish(spark: SparkSession, data: bytes) -> str:
    """Name of a Spark file with these bytes; written to the shared folder first, so any executor can fetch it."""
    sc, name = spark.sparkContext, f"digests-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(data))
    out.close()
    sc.addFile(fs.makeQualified(path).toString())
    return name


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per input row: id, host, path, rule (null if none), verdict."""
    names = [publish(pages.sparkSession, build(part)) for part in dealt(rules)]
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        arrays = [DigestArray(SparkFiles.get(name)) for name in names]
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            hosts, paths = [h for h, _ in parts], [p for _, p in parts]
            found, verdicts = longest([a.judge(hosts, paths, default) for a in arrays])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts))], names=[id_col, "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, f"{field_ddl(rows, 'id', id_col)}, host string, path string, rule string, verdict string")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


#: The host and the path by pattern, the rules one by one.
SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(h, p, v)),
m AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
