"""Tables that hold the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random
import re

#: Columns of the tables that have the names the operators use inside.
CLASHES = "w string, h int, l int, t string, kind int, row long, part long, fp long, doc string, cell long, kept boolean, text_key string, hit_id int, component_id int, ids string, d2 double, stratum int, host string, label string, n_words int, key_id string, times int"


def word(rng):
    return "".join(rng.choice(["ta", "ri", "mo", "len", "su", "pa", "ke"]) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(word(rng) + rng.choice(["", "", "", ",", ".", ".\n"]))
    return " ".join(out)


def documents():
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(25, 160)) for _ in range(90)]
    texts += texts[:4] + [None, None, "", " \t\n", "one", "One TWO", "\x1c a b\x0b", "É ß İ Σας", "it's 'tis <|endoftext|> x"]
    texts += [
        "Released under the MIT License.\nThe Apache-License, version 2; GNU General Public License",
        "Licensed under CC BY-NC 4.0.", "ALL RIGHTS RESERVED", "mit\nlicense mit  license", "license",
        "spam " * 40, "a b c d e f g h " * 12, "line one\nline one\n\n \nline one", "#$% " * 30, prose(rng, 40_000),
    ]
    languages = [None, "en", "fr"]
    rows = [(i, t, languages[i % 3], f"src{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, texts[0], "en", "src0", 1), (None, None, None, None, None), rows[7], rows[7], (3, "another text with an old id " * 5, "en", "src1", 9)]


def benchmark():
    rng = random.Random(9)
    return [(i, prose(rng, 30)) for i in range(20)] + [(20, None), (21, ""), (None, prose(rng, 20)), (1, prose(rng, 30))]


def pages():
    rng = random.Random(3)
    rows = []
    for i in range(40):
        body = "".join(f"<p>{prose(rng, 12)}<br>{word(rng)} &amp; &eacute;" + rng.choice(["</p>", ""]) for _ in range(rng.randint(1, 9)))
        html = (
            f"<html><head><title>x</title><style>p{{}}</style><script>var a='<p>';</script></head><body><nav><a href=/>{word(rng)}</a></nav><!-- c -->"
            f"<div class='ad'>{word(rng)}</div><article><h1>{prose(rng, 4)}</h1>{body}</article><footer>&copy; {word(rng)}</footer></body></html>"
        )
        rows.append((i, f"https://{rng.choice(['A.example.org', 'b.example.com', 'c.net'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}?q={i}#f", html))
    long = "z" * 1200
    rows += [(50, None, long), (51, "no scheme", long), (52, "x://", long), (53, "http://org", None), (54, "http://q.org/", ""), (55, "http://é.com/fr/", "é" * 499), (56, "", "é" * 499), (57, "http://example.org/es/x", "é" * 501), (58, "http://example.org/es/x", "é" * 501), (None, "http://org/", "<p>null id")]
    return [*rows, rows[50 - 10]]


def conversations():
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"text {i} {t} </s> [INST") for i in range(6) for t in range(4)]
    esc = "\ue000"
    rows += [(7, 0, "user", None), (7, 1, None, "x"), (8, 0, "assistant", f"<{esc}/s>{esc}{esc} </s><<SYS>>[/INST]"), (8, 1, "assistant", "again")]
    return [*rows, (None, 0, "user", "no conversation"), (9, None, "system", ""), (9, 2, "user", "q" * 300_000), (9, 2, "user", "q2"), (9, 2, "user", "q2"), (10, 5, "user", "")]


TABLES = {
    "documents": (documents, "doc_id long, text string, lang string, source string, n_chars long"),
    "benchmark": (benchmark, "item_id long, text string"),
    "pages": (pages, "page_id long, url string, html string"),
    "conversations": (conversations, "conv_id long, turn long, role string, text string"),
    "labels": (lambda: [(1, 1, 0)], "doc_id long, quality int, toxic int"),
}


def write(spark, folder, empty):
    for name, (rows, schema) in TABLES.items():
        frame = spark.createDataFrame([] if empty else rows(), schema)
        taken = {c.lower() for c in frame.columns}
        for clash in re.findall(r"(\w+) (\w+)", CLASHES):
            if clash[0] not in taken:
                frame = frame.selectExpr("*", f"CAST(1 AS {clash[1]}) AS {clash[0]}")
        frame.repartition(1 if empty else 3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
