import re
import zlib

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
CLASHING = "rest string, keys int, copy int, grp int, n_lines int, n_removed int, block int, band int, salt int, score int"


def documents(spark, extra=False):
    """Nulls, empty and blank texts, a very long one, repeats, ties, odd white space; with clashing columns."""
    long = " ".join(f"word{i % 5003}" for i in range(30_000))
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [
        (1, f"{passage} and the first goes on\nA line.\n\nAnother line here."),
        (2, f"something else, then {passage} and the second ends"),
        (2, f"something else, then {passage} and the second ends"),
        (3, None), (4, ""), (5, " \n\t \n"), (6, long), (7, long + " more"), (8, "A line.\nOnly here.\nAnother line here.\n"),
        (9, "Éé don't  stop 　now <|endoftext|>\r\n\r\n  99 👍🏽"), (None, passage), (None, None), (10, "A line."), (11, "A line."),
    ]
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    values = ("r", 1, 2, 3, 4, 5, 6, 7, 8, None)
    return spark.createDataFrame([(*r, "en", "s", 3, *values) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


def empty(spark, df):
    return spark.createDataFrame([], df.schema)


def words(text):
    return WORD.findall((text or "").encode())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain(frame, *columns):
    """Rows as tuples, in a fixed order."""
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)
