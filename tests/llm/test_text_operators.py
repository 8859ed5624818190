import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from turnsieve.llm import automata, bpe, cuts, lookalike, packing, pairs, personal, tokens

PROMPT = "[T0] USER: Hello, I want to book a table, with food pho if that works.\n[T1] SYSTEM: Done, the food is set to pho.\n\nQuestion: Which food holds at the end?\nReply with one JSON object holding value, support and abstain."
ANSWERS = [
    (None, "empty"), ("", "empty"), (" ​ \n", "empty"), ("{}", "empty"), ("```json\n```", "empty"), ("null", "empty"), ('{"value": "", "support": "", "abstain": false}', "empty"), ('{"value": null, "support": null, "abstain": false}', "empty"),
    ('{"value": "", "support": "", "abstain": true}', None), ('{"value": "pho", "support": "", "abstain": false}', None), ("pho", None), ("The user wants pho.", None), ('```json\n{"value": "pho", "support": "Done", "abstain": false}\n```', None),
    ('{"value": "pho", "support": "Done, the fo', "truncated"), ('{"value": "pho", "support": "Done, the fo", "abstain": false}', "truncated"), ('{"value": "pho", "support": "Done, the food", "abstain": false}', None), ("The user wants ph", "truncated"), ("The user wa", "truncated"),
    ("It should be pho. Accord", "truncated"), ('```json\n{"value": "pho"}\n``', "truncated"), ('{"value": "pho", "su�', "truncated"), ('{"value": "pho", "abst...', "truncated"),
    ("I'm sorry, but I am not able to help with this request.", "refusal"), ("很抱歉，我无法回答这个问题。", "refusal"), ('{"value": "I must decline to respond here.", "support": "", "abstain": false}', "refusal"),
    ("Which food holds at the end?", "copied_question"), ("WHICH FOOD HOLDS AT THE END", "copied_question"), ("Which food holds at the end?\nReply with one JSON object holding value, support and abstain.", "copied_question"), ("Which food holds at the end? pho", None), ("Which food holds at the end? The user wants pho.", None),
    ("Die Antwort lautet pho, so steht es im Gespräch.", "other_language"), ("用户想要一间便宜的房间，含早餐。", "other_language"), ("대화에 따르면 답은 pho입니다.", "other_language"), ("El usuario quiere una mesa para la cena.", "other_language"), ("Smörgård", None),
]


@pytest.mark.parametrize("text,want", ANSWERS)
def test_answer_defects(text, want):
    assert pairs.classify(text, PROMPT) == want


REVIEWED = [
    ("I'm afraid that's not something I can do.", "refusal"), ("I apologize, but helping with that would be irresponsible.", "refusal"), ("As an AI, I do not have the ability to respond to that.", "refusal"), ("Je suis désolé, je ne peux pas répondre à cette question.", "refusal"), ("お答えできません。", "refusal"),
    ("Пользователь хочет суп на ужин.", "other_language"), ("Secondo la conversazione, l'utente vuole la pizza alla fine.", "other_language"), ("De acordo com a conversa, o usuário quer uma mesa para o jantar.", "other_language"), ("会話によると、ユーザーはフォーを選びました。", "other_language"), ("Η απάντηση είναι φο και ρύζι", "other_language"),
    ("Pho was picked because the", "truncated"), ("Plaza de la Reina", None), ("The user wants Plaza de la Reina.", None), ("Кафе Лесна", None), ("I can't find it", None), ("Le Pré Orvé", None),
]


@pytest.mark.parametrize("text,want", REVIEWED)
def test_answers_of_the_review(text, want):
    assert pairs.classify(text, PROMPT) == want


def test_sentences_without_an_end_by_their_source():
    assert pairs.classify("Pho is what they settled on at last", PROMPT, True) == "truncated" and pairs.classify("Pho is what they settled on at last", PROMPT, False) is None
    assert pairs.classify("find somewhere to eat; food: pho", PROMPT, True) is None


@pytest.mark.parametrize("prompt", [None, "", "no question"])
def test_answers_without_a_prompt(prompt):
    assert pairs.classify("pho", prompt) is None and pairs.classify(None, prompt) == "empty"
    assert pairs.classify("{" * 50_000, prompt) == "truncated"


@settings(max_examples=80, deadline=None)
@given(st.text("ab", max_size=20), st.text("abc", max_size=20), st.integers(1, 4))
def test_suffix_automaton_against_brute_force(text, other, least):
    marks, best = [False] * len(other), 0
    for i in range(len(other)):
        for j in range(i + 1, len(other) + 1):
            if other[i:j] in text:
                best = max(best, j - i)
                if j - i >= least:
                    marks[i:j] = [True] * (j - i)
    assert automata.SuffixAutomaton(text).coverage(other, least) == (sum(marks), best)


ROWS = "answer_no bigint, id string, reader_output_text string, error string, source string, text string, dataset string"
PROBES = "row_id bigint, request_id string, dialogue_id string, dataset string, prompt_user string, compressed_text_used string, text string"


def test_pairs_on_tables(spark):
    answers = spark.createDataFrame([(i, "r" if i % 3 else None, t, None, None, "clash", "x") for i, (t, _) in enumerate(ANSWERS)], ROWS)
    probes = spark.createDataFrame([(1, "r", "d", "sgd", PROMPT, None, "c"), (2, "r", "d", "sgd", "other", None, "c"), (3, None, None, None, None, None, None)], PROBES)
    found = {r["answer_no"]: r["defect"] for r in pairs.broken_pairs(answers, probes).collect()}
    assert found == {i: pairs.classify(t, PROMPT if i % 3 else None) for i, (t, _) in enumerate(ANSWERS) if pairs.classify(t, PROMPT if i % 3 else None)}
    assert pairs.broken_pairs(answers.limit(0), probes).count() == 0
    assert sum(r["n_answers"] for r in pairs.defect_report(answers, probes).collect()) == len(ANSWERS)


def test_every_source_has_its_own_baseline(spark):
    # 1,000 larger sources without terminators do not speak for the last two, one of them null
    text = lambda ended: f"'The table is for four people{'.' if ended else ''}'"
    loose = spark.range(31_000).selectExpr("id as answer_no", f"{text(False)} as reader_output_text", "concat('s', id % 1000) as source")
    strict = spark.range(31_000, 31_060).selectExpr("id as answer_no", f"if(id < 31002, {text(False)}, {text(True)}) as reader_output_text", "if(id % 2 = 0, 'z', null) as source")
    few = spark.range(31_060, 31_062).selectExpr("id as answer_no", f"{text(False)} as reader_output_text", "'few' as source")
    answers = loose.union(strict).union(few).withColumn("id", F.lit(None).cast("string"))
    probes = spark.createDataFrame([], PROBES)
    own, rest = pairs.sentence_ends(answers)
    assert own.groupBy("strict").count().orderBy("strict").collect() == [(False, 1000), (True, 2)] and rest.first()["strict"] is False
    assert sorted(pairs.broken_pairs(answers, probes).collect()) == [(31_000, "truncated"), (31_001, "truncated")]
    turns = spark.createDataFrame([], "dialogue_id string, turn_id int, text string, loaded_at timestamp")
    assert {r["row_key"] for r in cuts.truncated_records(probes, turns, answers).collect()} == {31_000, 31_001}


WHOLE = "Sure, that works. See you at 10:30."


@pytest.mark.parametrize(
    "tail,want",
    [(WHOLE, False), (WHOLE + " \n", False), ("Sure, that works.", True), (WHOLE[:-1], False), ("Sure, th", True), ("Sure, th…", True), ("Sure, th [...]", True), ("Sure, t�", True), (WHOLE + "…", False), ("", True)],
)
def test_cut_contexts(tail, want):
    assert cuts._cut(tail, automata.open_text(tail), WHOLE) is want


@pytest.mark.parametrize(
    "text,left",
    [
        ("All (of it) “is” closed.", ""), ("It said \"yes.\"", ""), ("It said \"yes", "\"."), ("open (here", "(."), ("a 「word", "「."), ("see <b", "<."), ("see <b>bold</b>.", ""), ("path \\u00", "\\."), ("caf�", "�."), ("so th…", "…"), ("so th [...]", "…"), ("", ""), ("no end", "."),
        ("don't stop.", ""), ("wrong ) closer.", ""), ("(" * 3, "(((."),
    ],
)
def test_open_text(text, left):
    assert automata.open_text(text) == left


def test_cuts_on_tables(spark):
    turns = spark.createDataFrame([("d", 0, WHOLE, None), ("d", 0, WHOLE, None), (None, None, None, None)], "dialogue_id string, turn_id int, text string, loaded_at timestamp")
    texts = [f"[T0] USER: {WHOLE}", "[T0] USER: Sure, th", None, "", "[T0] US", f"[T0] USER: {WHOLE}\n[T1", "[T9] USER: unknown", "x" * 60_000]
    texts += [f"[T0] USER: {WHOLE}\n[T12] SYS [...]", f"[T0] USER: {WHOLE}\n[", "[T0] USER: ", "[T9] USER: open (bracket", "[T9] USER: Whole."]
    probes = spark.createDataFrame([(i, "r", "d" if i != 6 else None, "sgd", None, t, "c") for i, t in enumerate(texts)], PROBES)
    got = {r["row_id"] for r in cuts.cut_contexts(probes, turns).where("is_cut").collect()}
    assert {1, 4, 5, 8, 9, 10, 11} <= got and not got & {0, 2, 3, 12}
    assert cuts.cut_contexts(probes.limit(0), turns.limit(0)).count() == 0


def test_every_dataset_has_its_own_baseline(spark):
    # 1,000 larger datasets whose turns have no terminators do not speak for the last one
    loose = spark.range(31_000).selectExpr("concat('k', id % 1000, '-', id) as dialogue_id", "0 as turn_id", "'no end' as text")
    strict = spark.range(30).selectExpr("concat('z-', id) as dialogue_id", "0 as turn_id", "'An end.' as text")
    turns = loose.union(strict).withColumn("loaded_at", F.lit(None).cast("timestamp"))
    probes = turns.groupBy(F.substring_index("dialogue_id", "-", 1).alias("of")).agg(F.min("dialogue_id").alias("dialogue_id"))
    probes = probes.select(F.xxhash64("of").alias("row_id"), "dialogue_id", F.col("of").alias("dataset"), F.lit("[T9] USER: unknown").alias("compressed_text_used"))
    assert [r["dataset"] for r in cuts.cut_contexts(probes, turns).where("is_cut").collect()] == ["z"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder()


def test_ids_equal_the_library(encoder):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{bpe.VOCABULARIES}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    rng = random.Random(0)
    texts = ["<|endoftext|>", "don't I'LL", " 　x  ", "é", "\U0001f469‍\U0001f4bb", "a" * 5000] + ["".join(rng.choice("aabcdeé日本 \n\t.,1239한²") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    for t in texts:
        assert encoder.encode(t) == library.encode(t, add_special_tokens=False).ids
        assert encoder.count(t) == len(encoder.encode(t))
    for _ in range(50):
        raw = "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 400))).encode()
        assert encoder._scan(raw) == encoder._heap(raw)


DOCS = "doc_id bigint, text string, source string, lang string, domain string, ids string, n_tokens string"
TEXTS = [None, "", "  ", "hello there", "hello there", "日本 " * 3000, "x" * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i == 3 else "s", ["en-US", "EN", None, "und", "de-x", "", "zh"][i], None, "clash", "clash") for i, t in enumerate(TEXTS)], DOCS)


def test_corpus_ids_and_counts(docs, encoder):
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(docs).collect()}
    assert got == {i: encoder.encode(t) for i, t in enumerate(TEXTS)} and got[0] == got[1] == []
    assert tokens.encode_corpus(docs.limit(0)).count() == 0


def test_slice_totals_equal_text_totals(docs):
    texts = tokens.document_texts(docs)
    whole = {}
    for r in tokens.text_tokens(texts).collect():
        key = (r["slice"], r["lang"], r["domain"])
        n, t = whole.get(key, (0, 0))
        whole[key] = (n + 1, t + r["n_tokens"])
    assert {(r["slice"], r["lang"], r["domain"]): (r["n_texts"], r["n_tokens"]) for r in tokens.slice_totals(texts).collect()} == whole
    assert {k[1] for k in whole} == {"en", "unknown", "de", "zh"}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15), st.integers(20, 40))
def test_packing_uses_every_item_once_and_is_no_worse_than_first_fit(counts, capacity):
    counts = {s: n for s, n in counts.items() if s <= capacity}
    out = packing.pack_sizes(counts, capacity)
    used = {}
    for pattern, times in out:
        assert sum(s * k for s, k in pattern.items()) <= capacity and times > 0
        for s, k in pattern.items():
            used[s] = used.get(s, 0) + k * times
    assert used == counts
    bins = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        at = next((i for i, b in enumerate(bins) if b + s <= capacity), None)
        if at is None:
            bins.append(s)
        else:
            bins[at] += s
    n = sum(t for _, t in out)
    assert math.ceil(sum(s * k for s, k in counts.items()) / capacity) <= n <= len(bins)


def test_packing_small_cases_exactly():
    assert sum(t for _, t in packing.pack_sizes({1: 1, 11: 1, 12: 3}, 24)) == 2
    assert sum(t for _, t in packing.pack_sizes({6: 2, 5: 2, 4: 2}, 15)) == 2
    assert packing.pack_sizes({}, 10) == [] and packing.pack_sizes({11: 3}, 10) == []


def test_containers(spark, docs):
    targets = spark.createDataFrame([(1, "a", 512), (2, "b", 4096)], "target_id bigint, target_name string, capacity_tokens bigint")
    rows = packing.pack(docs, targets).collect()
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokens.sized(docs).collect()}
    for target, capacity in ((1, 512), (2, 4096)):
        own = [r for r in rows if r["target_id"] == target]
        for d, n in sizes.items():
            parts = sorted((r["part_no"], r["n_tokens"]) for r in own if r["doc_id"] == d)
            assert [p for p, _ in parts] == list(range(max(1, -(-n // capacity)))) and sum(x for _, x in parts) == n
        fill = {}
        for r in own:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        assert max(fill.values()) <= capacity and sorted(k for k, v in fill.items() if v) == list(range(len([v for v in fill.values() if v])))
    assert packing.pack(docs.limit(0), targets).count() == 0


MODEL = lookalike.Bigrams({p: 5 for w in (" south ", " east ", " coffee ", " Кафе ", " Лесна ", " Ταβέρνα ") for p in (w[i : i + 2] for i in range(len(w) - 1))})
SAME = [("ѕоuth", "south"), ("sօuth", "south"), ("ѕᴏuth", "south"), ("𝐬outh", "south"), ("ꜱouth", "south"), ("𝟏𝟑:00", "13:00"), ("ｅａｓｔ", "east"), ("е​ast ", "east"), ("cоfﬁ", None), ("Kафе", "Кафе"), ("Kaфe Лeснa", "Кафе Лесна"), ("13∶00", "13:00"), ("１３：００", "13:00"), ("⼉", "儿"), ("döner", "döner"), ("한", "한"), ("a b", "a b"), ("north‐east", "north-east")]


@pytest.mark.parametrize("text,want", [x for x in SAME if x[1]])
def test_one_form(text, want):
    assert lookalike.canonical(text, MODEL) == want


@pytest.mark.parametrize("text", ["", "Suite 40 m²", "½ Moon", "№ 9", "Кафе Лесна", "Ταβέρνα", "döner", "한식", "川菜", "x" * 20_000])
def test_plain_texts_stay(text):
    assert lookalike.canonical(text, MODEL) == text


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20))
def test_the_one_form_is_stable(text):
    once = lookalike.canonical(text, MODEL)
    assert lookalike.canonical(once, MODEL) == once


def test_values_on_tables(spark):
    probes = spark.createDataFrame([(1, "ѕоuth", None, "east", "c"), (2, "", "south", "ｅａｓｔ", "c")], "row_id bigint, new_value string, old_value string, gold string, value string")
    values = spark.createDataFrame([("south", "area"), ("east", "area"), (None, None)], "value_text string, slot_human string")
    labels = spark.createDataFrame([("find a train",), (None,)], "goal_text string")
    assert {tuple(r) for r in lookalike.substituted_fields(probes, values, labels).collect()} == {(1, "new_value"), (2, "gold")}
    assert lookalike.substituted_fields(probes.limit(0), values, labels).count() == 0


MENTIONS = [
    ("Cc: ann.lee+x@post.example.", [("email", "ann.lee+x@post.example")]), ("write ann [at] post (dot) lumo (dot) test.", [("email", "ann [at] post (dot) lumo (dot) test")]), ("ann at lumo dot test please", [("email", "ann at lumo dot test")]), ("ann@​lumo.test", [("email", "ann@​lumo.test")]), ("ann＠lumo.test", [("email", "ann＠lumo.test")]),
    ("kept 2 turns with first_n@0.7. results/recency@s40", []), ("call +1-212-555-0177 ext. 57 now", [("phone", "+1-212-555-0177 ext. 57")]), ("tel five five five, zero one zero nine /", [("phone", "five five five, zero one zero nine")]), ("手机１００９５５５７９８９", [("phone", "１００９５５５７９８９")]),
    ("The tracking code is 5753684165833320, no rush.", []), ("Run 20250324-2711 finished", []), ("identity number 469-00-8250 in turn 36", [("id_number", "469-00-8250")]), ("证件号码：99809319630421124X", [("id_number", "99809319630421124X")]),
    ("I live at Flat 17, 39 Quarry Ave. in Selbury", [("address", "Flat 17, 39 Quarry Ave.")]), ("Wir wohnen jetzt Kestelstraße 193c.", [("address", "Kestelstraße 193c")]), ("J'habite 5 bis, rue des Tourelles, à Ostdale.", [("address", "5 bis, rue des Tourelles")]), ("我家在望溪街20号6栋966室，", [("address", "望溪街20号6栋966室")]),
    ("My name is D. Okundaye-Lorne and you can reach me", [("name", "D. Okundaye-Lorne")]), ("Regards, Thanecott, Tamsin", [("name", "Thanecott, Tamsin")]), ("Is Brenwick Grill open on Sundays?", []), ("탁윤슬 님이 17:15으로", [("name", "탁윤슬")]), ("我叫岑怀瑾，电话", [("name", "岑怀瑾")]), ("The night porter called.", []),
]


BEYOND_FRAMES = [
    ("Please forward this to Maria Gonzalez in accounting.", [("name", "Maria Gonzalez")]), ("I spoke to Rahul Mehta on Tuesday.", [("name", "Rahul Mehta")]), ("Sincerely yours, John Smith", [("name", "John Smith")]), ("the Maria Gonzalez Hotel is open", []), ("We stayed at Daniel Grill.", []),
    ("My passport 123456789 expired.", [("id_number", "123456789")]), ("my ssn is one two three four five six seven eight nine", [("id_number", "one two three four five six seven eight nine")]), ("+61 412 345 678", [("phone", "+61 412 345 678")]), ("Via Roma 12, Milano", [("address", "Via Roma 12")]),
    ("ruf an: null eins fünf eins zwei drei vier fünf sechs", [("phone", "null eins fünf eins zwei drei vier fünf sechs")]), ("电话是一三八零零一三八零零零。", [("phone", "一三八零零一三八零零零")]), ("공일공 일이삼사 오육칠팔", [("phone", "공일공 일이삼사 오육칠팔")]), ("zéro six un deux trois quatre cinq six", [("phone", "zéro six un deux trois quatre cinq six")]),
    ("escribe a ana arroba correo punto es por favor", [("email", "ana arroba correo punto es")]), ("ann{at}mail.test", [("email", "ann{at}mail.test")]), ("메일은 kim 골뱅이 naver 닷 com 입니다", [("email", "kim 골뱅이 naver 닷 com")]), ("The old one was 3 Tarn St. The new one", [("address", "3 Tarn St")]), ("I live at 3 Tarn Ave. in Selbury", [("address", "3 Tarn Ave.")]),
]


@pytest.mark.parametrize("text,want", MENTIONS + BEYOND_FRAMES)
def test_mentions(text, want):
    assert [(k, text[a:b]) for k, a, b in personal.mentions(text)] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["ann", " at ", " dot ", "lumo", "[at]", "@", ".", "test", " two", " five", " seven", ", "]), max_size=20).map("".join))
def test_rewriting_keeps_offsets(text):
    new, edits, _ = personal.undisguised(text)
    at = 0
    for a, b, x in edits:
        assert at <= a < b and x
        at = b
    whole = personal.source_spans([(0, len(new), "x")], edits)[0] if new else (0, len(text), "x")
    assert whole[:2] == (0, len(text))
    for i, ch in enumerate(new):
        a, b, _ = personal.source_spans([(i, i + 1, "x")], edits)[0]
        assert a < b and (text[a:b] == ch or any((a, b) == e[:2] for e in edits))


def test_redaction_leaves_the_rest():
    text = "​Cc: ann@lumo.test; the caller Ann Lee asked for a copy."
    assert personal.redact(text) == "​Cc: <email>; the caller <name> asked for a copy."
    assert personal.redact(None) is None and personal.redact("") == ""


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_mentions_are_ordered_spans(text):
    at = 0
    for _, a, b in personal.mentions(text):
        assert at <= a < b <= len(text)
        at = b


def test_mentions_on_tables(spark, docs):
    assert personal.personal_mentions(docs).count() == 0
    assert personal.redacted(docs).where("n_mentions = 0").count() == len(TEXTS)
    assert personal.personal_mentions(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_filling_has_least_waste(seed, monkeypatch):
    rng = random.Random(seed)
    room = rng.choice([60, 100, 500])
    left = {3 * rng.randint(3, 40): rng.randint(1, 4) for _ in range(12)} | {50: 1}
    sums = {0}
    for s, n in left.items():
        sums |= {x + s * k for x in sums for k in range(1, n + 1) if x + s * k <= room}
    sizes = sorted(left, reverse=True)
    found = {}
    for nodes in (10**9, 5):
        monkeypatch.setattr(packing, "NODES", nodes)
        found[nodes] = packing.best_filling(room, sizes, left)
        assert sum(found[nodes]) == max(sums) and all(found[nodes].count(s) <= left[s] for s in found[nodes])
    assert found[5] == found[10**9]


def test_filling_is_exact_beyond_the_nodes():
    sizes = [*range(2100, 300, -3), 100]  # all but one are multiples of 3: only 100 fills 4000 whole
    filling = packing.best_filling(4000, sizes, dict.fromkeys(sizes, 1))
    assert sum(filling) == 4000 and 100 in filling


def test_bin_completion_stops_where_it_cannot_equal_the_incumbent():
    assert packing.complete_bins({5: 4}, 10, 1) is None
    assert packing.complete_bins({5: 4}, 10, 2) == [({5: 2}, 2)]


def test_packing_above_the_search_items_meets_a_tighter_count():
    sizes = dict.fromkeys(range(300, 1501, 3), 5)
    for hot, capacity, before in ((3000, 2000, 2405), (100, 2000, 955), (3000, 3000, 1604)):
        counts = sizes | {1000: hot}
        out = packing.pack_sizes(counts, capacity)
        used = {s: sum(p.get(s, 0) * t for p, t in out) for s in counts}
        assert used == counts and all(sum(s * k for s, k in p.items()) <= capacity for p, _ in out)
        assert sum(t for _, t in out) <= before - (capacity == 2000)


@pytest.mark.parametrize("at", ["@", " @ ", "[at]", "[ at ]", "(at)", "( at )", "{at}", "{ at }", " {at} ", "<at>", " <AT> "])
def test_every_disguise_of_at_is_searched(at):
    text = f"write to ann{at}mail.test soon"
    assert [text[a:b] for a, b, kind in personal._spans(text) if kind == "email"] == [f"ann{at}mail.test"]


@pytest.mark.parametrize("seed,bins,capacity", [(s, 80, 100) for s in range(8)] + [(s, 60, 100) for s in range(8, 12)] + [(0, 400, 1000), (1, 400, 1000)])
def test_packing_finds_known_perfect_packings(seed, bins, capacity):
    rng = random.Random(seed)
    counts = {}
    for _ in range(bins):
        a, b = sorted(rng.sample(range(1, capacity), 2))
        for s in (a, b - a, capacity - b):
            counts[s] = counts.get(s, 0) + 1
    out = packing.pack_sizes(counts, capacity)
    assert sum(t for _, t in out) == bins and sum(t * sum(p.values()) for p, t in out) == sum(counts.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8), st.just(12))
def test_packing_is_optimal_on_small_cases(sizes, capacity):
    def fits(items, bins):
        if not items:
            return True
        return any(b >= items[0] and b not in bins[:i] and fits(items[1:], [*bins[:i], b - items[0], *bins[i + 1 :]]) for i, b in enumerate(bins))

    counts = {s: sizes.count(s) for s in set(sizes)}
    n = sum(t for _, t in packing.pack_sizes(counts, capacity))
    assert packing.lower_bound(counts, capacity) <= n if sizes else n == 0
    assert fits(sorted(sizes, reverse=True), [capacity] * n) and not (n and fits(sorted(sizes, reverse=True), [capacity] * (n - 1)))
