"""Short notices with edited words."""

from millrace.llm import license


def test_an_edited_short_notice_keeps_its_label(spark):
    rows = [(1, "Licensed under the GNU General Public License, either version 3"), (2, "licensed under the gnu general new public license version 3"), (3, "licensed under the general license of version 3"), (4, "general public license " * 50)]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "gpl-3" in got[1].labels and "gpl-3" in got[2].labels and "gpl-3" not in got[3].labels and "gpl-3" not in got[4].labels
    assert got[1].score == 7 / 9 and got[2].score == 1


def brute_labels(text, settings=license.Settings()):
    """Labels and score by comparing words along all diagonals, one by one."""
    import re

    from brute import FOLD, PHRASES

    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    labels, score = set(), 0.0
    for phrase, label in PHRASES.items():
        p = phrase.split()
        if any(ws[i : i + len(p)] == p for i in range(len(ws))):
            labels.add(label)
            score = 1.0
    found = {}
    for label, notice in ((label, n) for label, ns in license.NOTICES.items() for n in ns):
        t = notice.split()
        agree = {}
        for i in range(len(ws) - 2):
            for j in range(len(t) - 2):
                if ws[i : i + 3] == t[j : j + 3]:
                    agree.setdefault(i - j, set()).update((j, j + 1, j + 2))
        for d in agree:
            share = len(set().union(*(agree[e] for e in agree if d <= e <= d + settings.drift))) / len(t)
            if share >= settings.coverage:
                found.setdefault(d, []).append((share, label))
    for own in found.values():
        labels |= {label for share, label in own if share == max(own)[0]}
        score = max(score, max(own)[0])
    return ",".join(sorted(labels)), score


def test_labels_and_score_are_those_of_the_slow_version(spark, edge_rows):
    mit, gpl = license.NOTICES["mit"][0], license.NOTICES["gpl-3"][1]
    half = len(gpl.split()) // 2
    first, second = " ".join(gpl.split()[:half]), " ".join(gpl.split()[half:])
    shuffled = " ".join(w for i in range(0, len(mit.split()), 5) for w in reversed(mit.split()[i : i + 5]))
    texts = {
        "repeated": "free of charge " * 60,
        "shuffled": shuffled,
        "turned": second + " " + first,
        "near": first + " a few words more " + second,
        "far": first + " word" * 40 + " " + second,
        "less": " ".join(w for i, w in enumerate(mit.split()) if i not in (7, 20, 33)),
        "plain": "x " + mit.upper() + " y",
    }
    rows = [*texts.items(), *((str(i), r[1]) for i, r in enumerate(edge_rows))]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for i, t in rows:
        labels, score = brute_labels(t)
        assert (got[i].labels, round(got[i].score, 9)) == (labels, round(score, 9)), i
    assert [got[i].labels for i in texts] == ["", "", "", "gpl-3", "", "mit", "mit"]
