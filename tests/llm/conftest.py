import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, repeats, near copies, shared passages, other scripts."""
    import random

    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéßñ中XY") for _ in range(r.randrange(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(120).split(" ")
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One two\x0bthree"), (5, "one TWO three")]
    rows += [(10 + i, " ".join(base)) for i in range(4)]
    for i in range(12):
        w = list(base)
        for _ in range(i % 6):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(99))
        rows.append((20 + i, " ".join(w)))
    rows += [(40 + i, text(50) + " " + passage + "\n" + text(30 + i)) for i in range(6)]
    rows += [(60, text(9000)), (61, "loop a b c d e " * 40), (62, "x\nsame line\nsame line\n#*$%&|<> y"), (63, "don't I'll ²½ ٣٤ 中文字 \U0001f600 \x1c\x85 end  ")]
    rows += [(70 + i, text(r.randrange(1, 90))) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with further columns, some named like the operators' own."""
    sources = ["s0", None, "s1"]
    rows = [(i, t, "xx", sources[i % 3], 1, "clash", -1.0) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, id double")
