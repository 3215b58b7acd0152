import hashlib
import random
import re

import numpy as np

from sparkquill.llm import char_tagger, pii


def brute(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and char_tagger.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_patterns_against_plain_regular_expressions():
    draw = random.Random(7)
    for _ in range(4000):
        text = "".join(draw.choice(("a", "é", "@", ".", "1", "23", "255", " ", "-", "+", "(", ")", "a@b.c", "4111111111111111", "%", "\n", "1.2.3.4")) for _ in range(draw.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text
    for text in ("+" * 50_000, "1" * 200_000, "a" * 100_000 + "@", "1." * 50_000, "a@" * 50_000, "1 " * 100_000):
        pii.base_spans(text)


def test_gradient_of_the_tagger():
    model = char_tagger.Tagger.new(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    draw = np.random.default_rng(2)
    ids, tags = draw.integers(0, 128, (3, 9)), draw.integers(0, char_tagger.TAGS, (3, 9))
    _, g = model.loss_and_gradient(ids, tags)
    for k in model.p:
        flat = model.p[k].reshape(-1)
        for at in draw.choice(np.flatnonzero(np.abs(g[k]).reshape(-1) > 1e-4), 3):
            old = flat[at]
            flat[at] = old + 1e-3
            up = model.loss_and_gradient(ids, tags)[0]
            flat[at] = old - 1e-3
            down = model.loss_and_gradient(ids, tags)[0]
            flat[at] = old
            assert abs((up - down) / 2e-3 - g[k].reshape(-1)[at]) < 1e-3 + 0.02 * abs(g[k].reshape(-1)[at]), k


def test_viterbi_against_all_paths():
    import itertools

    model, draw = char_tagger.Tagger.new(3), np.random.default_rng(3)
    model.p["trans"] = draw.standard_normal((char_tagger.TAGS, char_tagger.TAGS)).astype(np.float32)
    e = draw.standard_normal((1, 4, char_tagger.TAGS)).astype(np.float32)
    best = max(itertools.product(range(char_tagger.TAGS), repeat=3), key=lambda y: sum(e[0, t, y[t]] for t in range(3)) + sum(model.p["trans"][y[t], y[t + 1]] for t in range(2)))
    assert model.viterbi(e, np.array([3]))[0, :3].tolist() == list(best)
    paths = list(itertools.product(range(char_tagger.TAGS), repeat=3))
    weight = np.array([np.exp(sum(e[0, t, y[t]] for t in range(3)) + sum(model.p["trans"][y[t], y[t + 1]] for t in range(2))) for y in paths])
    for t in range(3):
        want = np.bincount([y[t] for y in paths], weight, char_tagger.TAGS) / weight.sum()
        assert np.allclose(model.marginals(e, np.array([3]))[0, t], want, atol=1e-4)


def test_tagger_finds_held_out_spans():
    model, draw = char_tagger.invented_tagger(), random.Random(123)
    hit = want = wrong = 0
    for _ in range(60):
        text, spans = char_tagger.labelled_text(draw)
        got = pii._tagged(model, [text])[0]
        hit += len(set(got) & set(spans))
        wrong += len(set(got) - set(spans))
        want += len(spans)
    assert hit / want > 0.6 and wrong / (hit + wrong) < 0.15


SENTENCES = ("Please write to {email} before Friday.", "You can reach our office at {phone} on weekdays.", "My number is {phone}; ask for Dr. Braun.", "Contact: {email} or {phone}, room 214.", "The server {ip} was down for 35 minutes on 2024-03-11.", "He paid with card {card} on 12/04/2023.", "Order #4481273 shipped; questions? {email}", "In 1987 the town had 12,431 inhabitants and 3.5 km of roads.", "Commit 9f3a77b21c0de4a5 fixed version 2.4.17 of the tool.", "See pages 112-118 and ISBN 978-3-16-148410-0.")


def sentences(draw):
    """English sentences, unlike the tagger's training text, and their spans."""
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    make = {
        "email": lambda: draw.choice(("anna", "bob.king", "j_smith", "kate99", "o.neil")) + draw.choice(("@", " (at) ", " [at] ")) + draw.choice(("corp.com", "uni-hamburg.de", "mail.example.org", "acme.co.uk")),
        "phone": lambda: draw.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}")).format(digits(3), digits(3), digits(4)),
        "ip": lambda: draw.choice((".", "[.]")).join(str(draw.randint(1, 254)) for _ in range(4)),
        "card": lambda: draw.choice((" ", "-", ".", "")).join(digits(4) for _ in range(4)),
    }
    text, spans = "", []
    for _ in range(8):
        for part in re.split(r"(\{\w+\})", draw.choice(SENTENCES)):
            if part.startswith("{"):
                value = make[part[1:-1]]()
                spans.append((part[1:-1], len(text), len(text) + len(value)))
                part = value
            text += part
        text += " "
    return text, spans


def test_tagger_on_text_of_another_kind():
    model, draw = char_tagger.invented_tagger(), random.Random(5)
    hit = want = wrong = beyond = beyond_hit = 0
    for _ in range(80):
        text, spans = sentences(draw)
        got = set(pii._tagged(model, [text])[0])
        base = set(brute(text))
        hit, wrong, want = hit + len(got & set(spans)), wrong + len(got - set(spans)), want + len(spans)
        beyond, beyond_hit = beyond + len(set(spans) - base), beyond_hit + len(got & (set(spans) - base))
    assert hit / want > 0.85 and wrong / (hit + wrong) < 0.03
    assert beyond > 200 and beyond_hit / beyond > 0.85


def test_windows_without_signs_and_pieces_of_runs_change_nothing(monkeypatch):
    model, draw = char_tagger.invented_tagger(), random.Random(11)
    texts = [char_tagger.labelled_text(draw)[0] for _ in range(40)]
    texts += [" ".join("plain words of prose " * draw.randint(0, 60) + x for x in (sentences(draw)[0] for _ in range(6))) for _ in range(20)] + ["", "no sign", "7" * 5000]
    want = pii._tagged(model, texts)
    assert sum(map(len, want)) > 300
    monkeypatch.setattr(pii, "AT_ONCE", 3)
    assert pii._tagged(model, texts) == want
    monkeypatch.setattr(pii, "RUN", 1024)
    assert pii._tagged(model, texts) == want
    monkeypatch.setattr(pii, "_windows", lambda x: [(0, max(64, -(-len(x) // 32) * 32 + 32))] if x else [])
    monkeypatch.setattr(pii, "RUN", 1 << 15)
    assert [set(x) for x in pii._tagged(model, texts)] == [set(x) for x in want]


def test_tagger_is_stored_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pii, "scratch_root", lambda _: f"file://{tmp_path}")
    trained = pii.tagger(spark)
    monkeypatch.setattr(pii, "invented_tagger", None)
    assert all((trained.p[k] == v).all() for k, v in pii.tagger(spark).p.items())


def test_query_and_mask(spark):
    texts = ["mail ann.b@x.org now +1 (559) 555-3817", "", None, "192.168.0.1 and 999.1.1.1", "card 4111 1111 1111 1111.", "no data here " * 3000 + "10.0.0.1", "call (559) 555-3817 today", "same a@b.co", "same a@b.co"]
    docs = spark.createDataFrame([(None if i == 5 else min(i, 7), t, 3, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, spans string").repartition(2)
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(texts)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        for r in by_id[None if i == 5 else min(i, 7)]:
            base = brute(t)
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in char_tagger.KINDS)
            assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(r.spans.split(","))
    out = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert out[0].text == "mail [EMAIL] now [PHONE]" and out[0].n_chars == len(out[0].text) and out[2].text is None
    assert out[None].text.endswith("here [IP]") and out[3].text == "[IP] and 999.1.1.1"
    assert pii.personal_data(docs.limit(0)).count() == 0
    dotted = docs.withColumnRenamed("spans", "a.b")
    assert pii.mask(dotted).columns == dotted.columns and pii.mask(dotted).count() == len(texts)
