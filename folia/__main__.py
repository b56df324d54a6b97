"""Converts one file: python -m folia IN OUT. Exit codes: 0 done, 1 failed, 2 wrong call."""

from __future__ import annotations

import sys
from pathlib import Path


def main(args: list[str]) -> int:
    kinds = (Path(args[0]).suffix.lower(), Path(args[1]).suffix.lower()) if len(args) == 2 else None
    if kinds not in ((".docx", ".pdf"), (".pdf", ".docx")):
        print("usage: python -m folia IN.docx OUT.pdf | IN.pdf OUT.docx", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from folia.plans import convert
    from folia.sources import ooxml

    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    try:
        files = ooxml.files(spark, str(Path(args[0]).resolve()), "*")
        row = (convert.packages_to_pages if kinds[0] == ".docx" else convert.pages_to_packages)(files).first()
        if row is None or row.content is None:
            print(row.status if row else "no such file", file=sys.stderr)
            return 1
        Path(args[1]).write_bytes(row.content)
        return 0
    except Exception as e:  # noqa: BLE001 - the exit code is the contract
        print(e, file=sys.stderr)
        return 1
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
