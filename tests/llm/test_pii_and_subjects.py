import random

from siftwright.llm import pii, subjects

FIRST, LAST = ["Mirela", "Jonas", "Celia", "Dario"], ["Lindmark", "Vermark", "Ostholme", "Blyholme", "Tannwyth", "Karrwyth"]


def corpus(n=1500):
    rng = random.Random(1)
    out = []
    for _ in range(n):
        who = f"{rng.choice(FIRST)} {rng.choice(LAST)}"
        out.append(
            rng.choice(
                [
                    f"My name is {who}. Thanks.",
                    f"According to {who}, nothing was lost.",
                    f"Call me on +1 303 555 0{rng.randrange(100, 200)} after six.",
                    f"Write to a{rng.randrange(99)}@post.example please. see ticket {rng.randrange(1000, 9999)}-{rng.randrange(100, 999)}",
                    f"They want my passport: K0{rng.randrange(100000, 999999)}",
                    f"I live at {rng.randrange(1, 200)} Old Mill Road.",
                    f"order #{rng.randrange(1000000, 9999999)} is still open, 10.3.5.12 answered, import core@4.2.3",
                    "Clone it with git@forge:tools/x.git first. The trademark filing is late.",
                ]
            )
        )
    return out


def test_field_finds_and_spares():
    texts = corpus()
    field = pii.Field(pii.Lexicon.learn(texts)).fit(texts)
    cases = {
        "I told CELIA TANNWYTH about it": {"name"},
        "According to Lindmark, Jonas, it works": {"name"},
        "WhatsApp +1 303 555 0151 or x [at] y [dot] example": {"phone", "email"},
        "passport K0123456 is what they have on file": {"id_number"},
        "Ship to 12 Old Mill Road, Apt 4": {"address"},
        "see ticket 8105-930, order #8213105, core@4.2.3, git@forge:tools/x.git, the trademark filing": set(),
        "": set(),
        "日本語だけ": set(),
    }
    for text, want in cases.items():
        assert {k for _, _, k in field.label([text])[0]} == want, text


def test_skip_edges_and_propagation():
    texts = corpus(400)
    field = pii.Field(pii.Lexicon.learn(texts))
    text = "My name is Jonas Lindmark. x Jonas Lindmark y"
    spans = pii.candidates(text, field.lexicon)
    assert len(spans) == 2 and (0, 1, True) in pii.Field.edges(text, spans)
    import numpy as np

    k = len(pii.LABELS)
    field.skip += 3 * np.eye(k, dtype=np.float32)
    scores = np.zeros((2, k))
    scores[0, 5] = 4.0
    scores[1, 0] = 0.5
    node, _ = field.beliefs(scores, [(0, 1, False), (0, 1, True)])
    assert node.argmax(1).tolist() == [5, 5]


def test_redact_table(spark):
    texts = corpus(600)
    field = pii.Field(pii.Lexicon.learn(texts)).fit(texts)
    df = spark.createDataFrame([("1", "My name is Jonas Lindmark!"), ("2", None), ("3", " "), ("4", "plain")], "k string, text string")
    got = {r.k: r.text for r in pii.redact(df, field).collect()}
    assert got == {"1": "My name is [NAME]!", "2": None, "3": " ", "4": "plain"}
    assert [r.k for r in pii.find(df, field).collect()] == ["1"]


def test_announced_and_accented_names_are_candidates():
    lexicon = pii.Lexicon.learn(corpus(400))
    names = lambda t: [t[a:b] for a, b, s in pii.candidates(t, lexicon) if s == "name"]
    assert names("Please ask Oona Grzybek's team. My name is Émile Zolair") == ["Oona Grzybek", "Émile Zolair"]
    assert names("the report of Mirela Lindmárk and of jonas ostholmé") == ["Mirela Lindmárk", "jonas ostholmé"]
    assert not list(pii.announced("answered in 7215 ms Ohne Bilanz")) and pii.fold("Łódź é 日") == "Lodz e 日"


def test_lexicon_is_counted_over_all_rows(spark):
    """A name in 3 of 40,000 texts, and one in a text of more than 20,000 characters, are learnt; the driver's Lexicon.learn gives the same."""
    plain = ["nothing of note here"] * 40_000 + ["the sorcery of it"] * 30
    rare = [f"My name is {x} Zyntharp." for x in ("Orla", "Bena", "Orla")] + ["y " * 12_000 + f"told {x} Quivcery" for x in ("Ilse", "Ilse", "Tove")]
    got = pii.train(spark.createDataFrame([(t,) for t in [*plain, *rare, None]], "text string")).lexicon
    want = pii.Lexicon.learn(plain + rare)
    assert got.endings == want.endings == {"harp", "cery"} and got.firsts == want.firsts == {"orla", "ilse"} and got.common == want.common == set("nothing of note here the sorcery it".split())


def test_unseen_names_of_other_endings():
    """Names and endings the field has never seen, by the words around them; pairs that are no names stay."""
    import itertools

    rng = random.Random(9)
    extra = [f"{a} {b} is on the {c} today, see {d}." for a, b, c, d in itertools.islice(zip(*[iter(rng.choices(["Release Notes", "Open Issues", "Style Guide", "Main Branch", "Data Sheet"], k=1200))] * 4), 300)]
    texts = corpus() + extra + ["the release notes and open issues of the style guide", "our main branch has a data sheet"] * 20
    field = pii.Field(pii.Lexicon.learn(texts)).fit(texts)
    first = ["John", "Maria", "Robert", "Anna", "Wei", "Priya", "Olu", "Tomás", "Ngozi", "Sven"]
    last = ["Smith", "Lopez", "Johnson", "Kowalska", "Zhang", "Raman", "Adeyemi", "Núñez", "Okafor", "Berg"]
    frames = ["My name is {}.", "Patient: {}", "according to {}, it works", "Regards,\n{}", "I told {} about it", "cc: {}"]
    held = [(f.format(f"{a} {b}"), f"{a} {b}") for f in frames for a in first for b in last]
    found = [[t[x:y] for x, y, k in spans if k == "name"] for (t, _), spans in zip(held, field.label([t for t, _ in held]), strict=True)]
    right = sum(who in got for got, (_, who) in zip(found, held, strict=True))
    assert right >= 0.9 * len(held) and right >= 0.9 * sum(map(len, found))
    plain = ["We read the Release Notes first.", "Open Issues on the Main Branch.", "Style Guide and Data Sheet"]
    assert not any(k == "name" for spans in field.label(plain) for _, _, k in spans)
    # an unannounced mention follows an announced one of the same text, and only of the same text
    text = "Patient: Olu Adeyemi. Later Olu Adeyemi left."
    assert [text[a:b] for a, b, _ in field.label([text])[0]] == ["Olu Adeyemi"] * 2
    assert [k for _, _, k in field.label(["我叫王小明。", "5 Rue de Rivoli", "see Kerkstraat 12", "Via Garibaldi 7"])[0]] == ["name"]
    assert [[k for _, _, k in s] for s in field.label(["we met at 5 Rue de Rivoli", "see Kerkstraat 12", "in Via Garibaldi 7", "ул. Ленина, д. 5"])] == [["address"]] * 4


def test_subjects(spark):
    rng = random.Random(2)
    words = {"cooking": ["dough", "oven", "salt", "broth"], "law": ["court", "appeal", "lawyer", "statute"], "sport": ["goal", "coach", "league", "relay"]}
    docs, labels, want = [], [], {}
    for i in range(240):
        about = rng.sample(sorted(words), rng.choice([1, 1, 2])) if i % 8 else []
        lines = [f"We still need to check the {rng.choice(words[s])} before the {rng.choice(words[s])} can go." for s in about for _ in range(4)] + ["Okay, next one."] * (2 if about else 4)
        rng.shuffle(lines)
        docs.append((i, " ".join(lines), "en", "clash"))
        want[i] = set(about)
        if i % 4 == 0 or not about:
            labels += [(i, s) for s in about] or [(i, None)]
    docs += [(900, None, "en", ""), (901, "", None, ""), (None, "x y", "en", "")]
    schema = "doc_id long, text string, lang string, subject string"
    got = {}
    for r in subjects.subjects_of(spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, subject string")).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == w for i, w in want.items())
    assert right >= 0.95 * len(want) and not {900, 901} & set(got)
    assert subjects.subjects_of(spark.createDataFrame([], schema), spark.createDataFrame([], "doc_id long, subject string")).count() == 0


def test_similarity_graph_is_verified_and_symmetric(spark, monkeypatch):
    """Each edge has the exact Jaccard similarity of the whole profiles; hot terms cut into ranges give edges too; labels of seeds stay."""
    rng = random.Random(3)
    docs = [(i, "en", rng.sample(range(100 * (i % 3), 100 * (i % 3) + 30), 12) + [7777]) for i in range(90)] + [(900, "de", [1, 2]), (901, "en", [])]
    held = spark.createDataFrame(docs, "doc_id long, lang string, terms array<long>")
    for group in (2000, 10):
        monkeypatch.setattr(subjects, "GROUP", group)
        edges = {(r.a, r.b): r.sim for r in subjects.similarity_graph(held, 0.5).collect()}
        own = {i: set(t) - {7777} for i, _, t in docs}
        assert len(edges) > 90 and all(edges[b, a] == s for (a, b), s in edges.items())
        assert all(a % 3 == b % 3 and abs(s - len(own[a] & own[b]) / len(own[a] | own[b])) < 1e-4 for (a, b), s in edges.items())
    labels = spark.createDataFrame([(i, f"s{i % 3}") for i in range(12)] + [(5000, "s1")], "doc_id long, subject string")
    state, clamped = subjects.propagate(held, labels)
    top = {r.doc_id: r.subject for r in state.where("n > 0.5").collect()}
    assert all(top[i] == f"s{i % 3}" for i in range(90)) and {(r.doc_id, r.subject) for r in clamped.collect()} >= {(i, f"s{i % 3}") for i in range(12)}


def test_similarity_graph_holds_every_pair(spark, monkeypatch):
    """All pairs that are alike are edges, also many under hot terms, those with one term in common, and across blocks; labels move over all of them."""
    rng = random.Random(4)
    docs = [(i, "en", [*rng.sample(range(40), 14), 7777]) for i in range(120)] + [(500 + i, "de", [i // 2, 50 + i // 3]) for i in range(12)] + [(900, "en", [])]
    held = spark.createDataFrame(docs, "doc_id long, lang string, terms array<long>")
    df = {}
    for _, lang, terms in docs:
        for t in terms:
            df[lang, t] = df.get((lang, t), 0) + 1
    own = {i: {(lang, t) for t in terms if 2 <= df[lang, t] <= max(2, 0.5 * sum(x[1] == lang for x in docs))} for i, lang, terms in docs}
    alike = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if a != b and own[a] & own[b]}
    want = {k: s for k, s in alike.items() if s >= subjects.ALIKE}
    assert len(want) > 13_000 and any(len(own[a] & own[b]) == 1 for a, b in want)
    said = {i: ("x" if i % 2 else "y", 0.25 + i % 3 / 4) for i in own if i % 5 < 2}
    state = spark.createDataFrame([(i, s, n) for i, (s, n) in said.items()], "doc_id long, subject string, n double")
    sums = {}
    for (a, b), s in want.items():
        if b in said:
            sums[a, said[b][0]] = sums.get((a, said[b][0]), 0) + round(s, 4) ** 2 * said[b][1]
    for group in (2000, 50, 2):
        monkeypatch.setattr(subjects, "GROUP", group)
        got = [(r.a, r.b, r.sim) for r in subjects.similarity_graph(held, 0.5).collect()]
        assert len(got) == len(want) and all(abs(want[a, b] - s) < 1e-4 for a, b, s in got)
        if group < 2000:
            heard = {(r.doc_id, r.subject): r.n for r in subjects._neighbours(subjects.profiles(held, 0.5), state).collect()}
            whole = {}
            for (a, _), k in sums.items():
                whole[a] = whole.get(a, 0) + k * k
            assert heard.keys() == sums.keys() and all(abs(n - sums[k] ** 2 / whole[k[0]]) < 1e-3 for k, n in heard.items())
