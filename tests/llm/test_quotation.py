import random
import re

from repolith.llm.quotation import conversations, link_quotations

MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
WROTE = re.compile(r"^\s*on\b.{0,200}wrote\s?:\s*$", re.I)


def sentences(text):
    flat = re.sub(r"[\s\"'“”«»]+", " ", text.lower())
    return [s for s in (re.sub(r"^[\W_]+|[\W_]+$", "", p) for p in re.split(r"(?<=[.!?])\s", flat)) if s]


def brute(rows):
    parsed = []
    for conv, turn, role, text in rows:
        lines = re.split(r"\r?\n", text or "")
        levels = [m.group(1).count(">") if (m := MARKS.match(x)) else 0 for x in lines]
        plain = [x for k, x in enumerate(lines) if not levels[k] and not (WROTE.match(x) and k + 1 < len(lines) and levels[k + 1])]
        plain = re.sub(r"^\n+|\n+$", "", re.sub(r"\n{3,}", "\n\n", "\n".join(plain)).strip(" "))
        runs = []
        for k, n in enumerate(levels):
            if n and k and levels[k - 1] == n:
                runs[-1][1].append(MARKS.sub("", lines[k]))
            elif n:
                runs.append((n, [MARKS.sub("", lines[k])], k))
        parsed.append((conv, turn, role, plain, [(n, " ".join(r), k) for n, r, k in runs]))
    holds = [(c, t, units(p, [p, *p.split("\n")])) for c, t, _, p, _ in parsed]
    out = []
    for conv, turn, role, plain, runs in parsed:
        answered, links = None, []
        for n, asked, at in runs:
            near, far = {}, {}
            for unit, weight in units(asked, [asked]).items():
                earlier = [t for c, t, h in holds if c == conv and t < turn and unit in h]
                if earlier:
                    near[max(earlier)] = near.get(max(earlier), 0) + weight
                others = [(c, t) for c, t, h in holds if c != conv and unit in h]
                if others:
                    far[min(others)] = far.get(min(others), 0) + weight
            size = len(set(sentences(asked)))
            if near:
                best = max(near, key=lambda t: (near[t], t))
                links.append((at, n, conv, best, min(size, near[best])))
                if n == 1 and answered is None:
                    answered = best
            elif far:
                best = min(far, key=lambda x: (-far[x], x))
                links.append((at, n, *best, min(size, far[best])))
        before = sorted({t for c, t, *_ in parsed if c == conv and t < turn})
        reply = answered if answered is not None else max(before, default=None)
        out.append((conv, turn, role, len(before), reply, len(runs), max([n for n, *_ in runs], default=0), len(links), links, plain))
    return sorted(out, key=repr)


def units(text, wholes):
    out = {s: 1 for s in sentences(text)}
    for w in wholes:
        if len(s := sentences(w)) > 1:
            out[" ".join(s)] = len(set(s)) + 1
    return out


def test_quotations_against_brute_force(spark):
    r = random.Random(2)
    say = lambda: " ".join("".join(r.choice("abcdeé") for _ in range(4)) for _ in range(5)).capitalize() + r.choice(".!?")
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(r.randint(1, 7)):
            lines = [say() for _ in range(r.randint(1, 3))]
            if texts and r.random() < 0.7:
                old = r.choice(texts) if r.random() < 0.8 else "No one said this. At all!"
                lines = [r.choice(["On Monday, X wrote:", "hm"]), *["> " + x for x in old.split("\n")], *lines]
            if rows and r.random() < 0.2:
                lines.insert(0, ">" + r.choice(rows)[3].split("\n")[-1].upper())
            texts.append("\n".join(lines))
            rows.append((conv, turn, r.choice(["user", "assistant"]), texts[-1]))
    rows += [(50, 0, "user", ""), (50, 3, "user", ">" * 30 + " deep\n\n\n\nok"), (50, 4, None, "word " * 20_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = [(*x[:8], [tuple(y) for y in x[8]], x[9]) for x in link_quotations(frame).collect()]
    assert sorted(got, key=repr) == brute(rows)
    assert any(x[7] for x in got) and any(x[6] > 1 for x in got)
    chat = conversations(link_quotations(frame)).collect()
    assert [(x["conv_id"], x["turn"]) for x in chat] == sorted((x["conv_id"], x["turn"]) for x in chat)
    assert not any(line.startswith(">") for x in chat for line in x["plain"].split("\n"))


def test_a_sentence_that_all_turns_repeat(spark):
    rows = [(1, t, "user", "ok then.\n> ok then.") for t in range(300)] + [(2, 5, "user", "> ok then.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {(x["conv_id"], x["turn"]): x for x in link_quotations(frame).collect()}
    assert all(got[1, t]["reply_to"] == t - 1 and got[1, t]["place"] == t for t in range(1, 300))
    assert got[2, 5]["reply_to"] is None and [tuple(x)[2:4] for x in got[2, 5]["links"]] == [(1, 0)]
    assert got[1, 0]["n_linked"] == 0


def test_odd_rows(spark):
    rows = [(None, 1, "user", "> a b c.\nx"), (1, None, "user", "y"), (1, 2, None, None), (1, 2, None, None), (1, 1, "user", "A b c."), (1, 1, "user", "again")]
    frame = spark.createDataFrame([(*x, 5, 6) for x in rows], "conv_id long, turn long, role string, text string, level int, plain int")
    got = sorted(((x["conv_id"], x["turn"], x["reply_to"], x["n_linked"], x["plain"]) for x in link_quotations(frame).collect()), key=repr)
    assert got == sorted([(None, 1, None, 0, "x"), (1, None, None, 0, "y"), (1, 2, 1, 0, ""), (1, 2, 1, 0, ""), (1, 1, None, 0, "A b c."), (1, 1, None, 0, "again")], key=repr)
    assert link_quotations(frame.where("false")).count() == 0
