"""The batch command: PNG files in, one export out."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import render as K
from . import api
from . import guidance as G
from .session import cut, ship


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lectern", description="Extracts character cards from PNG files and writes them as one export.")
    p.add_argument("inputs", nargs="+", help="PNG files or folders")
    p.add_argument("-o", "--output", default="cards_export.md")
    p.add_argument("-f", "--format", choices=api.FORMATS, default="md")
    p.add_argument("--full", action="store_true", help="cut nothing")
    p.add_argument("--max-chars", type=int, default=600, help="characters of a field beyond the first --full-top cards")
    p.add_argument("--cap", action="append", default=[], metavar="FIELD=CHARS", help="a field's own limit, for every card")
    p.add_argument("--fields", default=None, help=f"optional fields: {', '.join(K.EXTRA_FIELDS)}, all or none")
    p.add_argument("--tokenizer", default="heuristic")
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--sort", choices=("best", "file", "name"), default="best")
    p.add_argument("--full-top", type=int, default=10)
    p.add_argument("--best", type=int, default=None, help="only the best N cards")
    p.add_argument("--report-failures", default=None, metavar="FILE")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    ship(spark)
    from ..sources import cards as S
    from ..sources import png

    files = cut(png.scan(spark, a.inputs, not a.no_recursive))
    scanned = files.count()
    if not scanned:
        print("No PNG files found for the given inputs.", file=sys.stderr)
        return 1
    cards, failures = S.extract(files)
    cards, failures = cut(cards), cut(failures)
    _, bad = K.field_caps(a.cap)
    if bad:
        print(f"Ignored unrecognized --cap value(s): {', '.join(bad)}", file=sys.stderr)
    o = api.Options(a.format, a.full, a.max_chars, a.full_top, a.fields, a.cap, a.tokenizer, a.sort, a.best)
    made = api.exported(cards, o)
    text, count = made.text, made.tokens
    with open(a.output, "w", encoding="utf-8") as f:
        f.write(text)
    n, failed = cards.count(), failures.count()
    specs = ", ".join(f"v{r['spec_version']}: {r['cards']}" for r in A.spec_versions(cards).orderBy("spec_version").collect())
    print(f"Scanned {scanned} PNG file(s).\nExtracted {n} card(s) ({specs}).")
    kept = min(n, a.best) if a.best and a.best > 0 else n
    if kept < n:
        print(f"Kept the {kept} most instructive for the export (--best).")
    if failed:
        print(f"Skipped {failed} file(s) with no usable card data.")
    print(f"Wrote {a.format} export to {a.output}\n{count.count:,} tokens ({count.method})")
    for line in [*G.consistency_note(made.corpus.consistency), *G.context_warning(count.count, kept)]:
        print(line)
    if not a.full and a.full_top <= 0:
        r = A.truncation_ratio(cards, a.max_chars).first()
        if r["actual"] and r["shown"] / r["actual"] < 0.5:
            print(f"NOTE: --max-chars {a.max_chars} shows only {r['shown'] / r['actual']:.0%} of the description text ({r['shown']:,} of {r['actual']:,} chars); --full-top 10 shows the best complete.")
    if a.report_failures and failed:
        with open(a.report_failures, "w", encoding="utf-8") as f:
            f.writelines(f"{r['path']}: {r['reason']}\n" for r in failures.orderBy(F.col("path")).toLocalIterator())
        print(f"Wrote failure report to {a.report_failures}")
    return 0
