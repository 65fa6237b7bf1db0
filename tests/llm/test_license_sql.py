"""The license scan's SQL says the whole query, printed notices included."""

import random

import duckdb

from smoothlake.llm import license_scan


def texts():
    rng = random.Random(5)
    out = [None, "", "no license here", "CC BY and the General Public License, all rights reserved"]
    for several in license_scan.all_templates().values():
        for t in several:
            for keep in (0.0, 0.5, 1.0):  # optional regions left out, some, all; replaceable ones filled
                text, depth, drop = "", 0, False
                place = 0
                for m in [*license_scan.MARKUP.finditer(t), None]:
                    if not drop:
                        text += t[place : m.start() if m else len(t)]
                    if m is None:
                        break
                    place = m.end()
                    if m[1] == "beginOptional":
                        depth += 1
                        drop = drop or rng.random() >= keep
                    elif m[1] == "endOptional":
                        depth -= 1
                        drop = drop and depth > 0
                    elif not drop:
                        text += " " + " ".join(f"filled{i}" for i in range(rng.randint(0, int(m[2] or 0))))
                out += [f"Before this. {text.upper() if keep else text}; and after", text.replace(" the ", " that ", 1)]
    return out


def test_sql_equals_the_scan_on_every_notice(spark):
    rows = list(enumerate(texts()))
    got = sorted(tuple(r) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = "doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score"
    want = sorted(con.sql(f"SELECT {names} FROM ({license_scan.oracle()})").fetchall())
    assert got == want
    labels = {x for r in got for x in r[6].split(",")}
    assert labels >= set(license_scan.all_templates())
