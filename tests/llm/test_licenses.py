import random

from tarnwave.llm import licenses

from .fixtures import frame, prose

RULES = licenses.LicenseRules()


def found(text):
    m = licenses.Matcher(licenses.NOTICES, RULES)
    return [(j[0], text[j[4] : j[5]]) for j in m.find(text)]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def brute_ratio(own, said, at):
    return max(2 * common(own, said[a:b]) / (len(own) + b - a) for a in range(at + 1) for b in range(at + 1, len(said) + 1))


def test_two_notices_on_a_line():
    text = "Licensed under CC BY 4.0. Code is separate. Released under the MIT License. Licensed under CC BY 4.0."
    assert found(text) == [("CC-BY-4.0", "Licensed under CC BY 4.0"), ("MIT", "Released under the MIT License"), ("CC-BY-4.0", "Licensed under CC BY 4.0")]


def test_signal_near_the_end_of_another_window():
    text = "Copyright " + "x" * 74 + " Licensed under CC BY 4.0. " + prose(1, 60)
    assert found(text) == [("CC-BY-4.0", "Licensed under CC BY 4.0")]


def test_long_lines_against_brute_force():
    rng = random.Random(3)
    said = [w for _, t in licenses.NOTICES[:14] for w in licenses.words(t)]
    for _ in range(60):
        own = licenses.words(rng.choice(licenses.NOTICES[:14])[1])
        line = [w for w in own if rng.random() > 0.15]
        for _ in range(rng.randrange(4)):
            line.insert(rng.randrange(len(line) + 1), rng.choice(said))
        line = rng.sample(said, 5) + line + rng.sample(said, 5)
        at = rng.randrange(len(line))
        ids = {w: i for i, w in enumerate(dict.fromkeys(own + line))}
        got = licenses.best_span(*(licenses.np.array([ids[w] for w in ws]) for ws in (own, line)), at, licenses.Fraction("0.8"))
        want = brute_ratio(own, line, at)
        assert (got is None) == (want < 0.8 - 1e-12)
        if got:
            assert abs(float(got[0]) - want) < 1e-12 and got[1] <= at < got[2]


def test_every_notice_of_one_long_line(spark):
    rng = random.Random(5)
    notices = [rng.choice(licenses.NOTICES[:14]) for _ in range(40)]
    text = " ".join(f"{prose(i, 25)} {t}" for i, (_, t) in enumerate(notices))
    rows = licenses.scan_licenses(frame(spark, [(1, text), (2, prose(7, 50))])).orderBy("start").collect()
    assert [r["license_id"] for r in rows] == [i for i, _ in notices]
    assert [text[r["start"] : r["end"]] for r in rows] == [t.rstrip(".") for _, t in notices]
    assert all(r["agreement"] == 1 for r in rows)


def test_wrapped_notices():
    text = "# This work is licensed under\r\n# the GNU General Public License, version 3.\n\nReleased into the public\n * domain under CC0 1.0."
    assert [i for i, _ in found(text)] == ["GPL-3.0", "CC0-1.0"]


def test_bodies_in_comments():
    for i, t in licenses.NOTICES[14:]:
        said = t.split(" ")
        text = prose(1, 40) + "\nCopyright (c) 2020 A. Writer\n" + "\n".join(" * " + " ".join(said[k : k + 9]) for k in range(0, len(said), 9)) + "\n" + prose(2, 40)
        assert {j for j, _ in found(text)} == {i}, t


def test_spdx_expressions():
    text = "// SPDX-License-Identifier: (GPL-2.0-or-later OR MIT) AND Foo-1.0\n/* spdx-license-identifier: apache-2.0 */"
    assert found(text) == [("GPL-2.0", "SPDX-License-Identifier: (GPL-2.0-or-later"), ("MIT", "MIT"), ("Apache-2.0", "spdx-license-identifier: apache-2.0")]


def test_differences_against_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        own, said = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        missing, added = licenses.differences(own, said)
        assert len(own) - len(missing) == len(said) - len(added) == common(own, said)
        for words, lost in ((own, missing), (said, added)):
            at = iter(words)
            assert all(w in at for w in lost)


def test_ranking_against_brute_force():
    """The winner of a block: by bytes with each template as a dictionary, then by words, confirmed by a plain comparison."""
    import zstandard as zstd

    m, rng = licenses.Matcher(licenses.NOTICES, RULES), random.Random(4)
    for k in range(60):
        own = licenses.words(licenses.NOTICES[k % len(licenses.NOTICES)][1])
        block = tuple(w if rng.random() > 0.1 else rng.choice(("other", "words", "here")) for w in own if rng.random() > 0.05)
        ranked = []
        for i, (_, t) in enumerate(licenses.NOTICES):
            ratio = 2 * common(licenses.words(t), block) / (len(licenses.words(t)) + len(block))
            raw = zstd.ZstdCompressionDict(" ".join(licenses.words(t)).encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            if ratio >= 0.8:
                ranked.append((len(zstd.ZstdCompressor(level=3, dict_data=raw).compress(" ".join(block).encode())), -ratio, i))
        assert m.winner(block) == (min(ranked)[2] if ranked else None)


def test_every_template_wins_its_own_words():
    m = licenses.Matcher(licenses.NOTICES, RULES)
    for i, t in licenses.NOTICES:
        assert licenses.NOTICES[m.winner(tuple(licenses.words(t)))][0] == i


def test_edited_and_refused_whole_texts(spark):
    """Whole texts from a table: edits are told word by word; a text with a third of its words changed is no match."""
    rng = random.Random(6)
    whole = "The Lantern Public License. " + prose(31, 500) + " End of the license. " + prose(32, 100)
    said = whole.split(" ")
    edited, far = list(said), list(said)
    for k in range(40, 600, 40):
        edited[k] = f"edit{k}"
    for k in rng.sample(range(len(far)), len(far) // 3):
        far[k] = f"far{k}"
    given = spark.createDataFrame([("Lantern", whole), ("Lantern", whole), (None, "x"), ("None", None), ("Blank", " ")], "license_id string, text string")
    docs = frame(spark, [(1, " ".join(edited)), (2, " ".join(far)), (3, prose(9, 80) + " " + whole), (4, None), (5, "")])
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(docs, given).collect()}
    assert set(rows) == {1, 3}
    assert set(rows[1]["added"]) == {f"edit{k}" for k in range(40, 600, 40)} and len(rows[1]["missing"]) == len(rows[1]["added"])
    assert rows[3]["missing"] == rows[3]["added"] == [] and rows[3]["agreement"] == 1 and rows[3]["start"] == len(prose(9, 80)) + 1


def test_many_signals():
    text = "license " * 5000 + "Released under the MIT License. " + "copyright " * 5000
    assert found(text) == [("MIT", "Released under the MIT License")]
