import math

import numpy as np

from arrowlens.llm import quality

COMMON = ["the", "of", "is", "a", "to", "in", "and", "that"]


def stats(spark, texts, common=COMMON):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    return [r.asDict() for r in quality.with_form(quality.statistics(df, common)).orderBy("doc_id").collect()]


def test_counts_against_a_hand_count(spark):
    s = stats(spark, ["The cat is in.\n\nA dog, too!\nno end"])[0]
    assert (s["n_words"], s["n_lines"], s["n_chars"]) == (9, 3, 34)
    assert math.isclose(s["mean_word"], sum(map(len, "The cat is in A dog too no end".split())) / 9)
    assert math.isclose(s["common_share"], 4 / 9) and math.isclose(s["punct_lines"], 2 / 3)
    assert math.isclose(s["symbol_ratio"], 3 / 25)


def test_null_empty_and_blank_have_no_form(spark):
    for s in stats(spark, [None, "", " \n\t 　"]):
        assert s["n_words"] == 0 and s["n_lines"] == 0 and s["form"] is None and s["symbol_ratio"] is None and s["mean_word"] is None


def test_forms(spark):
    prose = "It is not clear that the cat is in the house, and the plan to move it has to wait. " * 3
    table = "\n".join(f"| a{i} | {i * 7} | xyz |" for i in range(8))
    items = "\n".join(f"- item {c}" for c in "abcdefgh")
    texts = [prose, table, items, "00 ff 3a 9b 1c " * 20, "=" * 200, "test " * 60, prose + "\n" + table * 5, "この記録は次の要素に属している。昨日の変更で索引が消えた。", prose * 400]
    assert [s["form"] for s in stats(spark, texts)] == ["prose", "table", "list", "junk", "junk", "junk", "table", "prose", "prose"]


def test_irep_finds_thresholds_and_case_sql_agrees(spark):
    rng = np.random.default_rng(0)
    x = np.full((900, len(quality.TESTED)), np.nan)
    x[:, :] = rng.random(x.shape)
    a, b = quality.TESTED.index("table_share"), quality.TESTED.index("list_share")
    y = np.where(x[:, a] > 0.6, "table", np.where(x[:, b] > 0.7, "list", "prose"))
    fitted = quality.irep(x, y, quality.TESTED)
    assert (quality.apply_rules(fitted, x) == y).mean() > 0.97
    cut = [t for r in fitted["rules"] if r["form"] == "table" for n, _, t in r["if"] if n == "table_share"]
    assert abs(cut[0] - 0.6) < 0.05
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x[:200]], ", ".join(f"{n} double" for n in quality.TESTED))
    assert [r.form for r in quality.with_form(rows, fitted).select("form").collect()] == list(quality.apply_rules(fitted, x[:200]))


#: Held out: none of these texts was fitted on.
NATURAL = {
    "en": ["Streetlights flickered in the strength of the storm. Three thoughtful children watched from the attic, counting the lengths of the pauses between lightning and thunder.", "Nit: `getCfg()` swallows ENOENT here. I'd rather let it throw, log the path (see src/io/read.ts:42) and exit 1; otherwise CI stays green while nothing is built.", "Sorry for the late reply! I was on a plane. Yes, let's meet on Tuesday at 3 pm; bring the drafts, and maybe some of that rhubarb cake.", "Sphinx of black quartz, judge my vow. Crwth players from Llanfrwst strummed hymns by the twelfth milestone while glyphs dried slowly in the crypt."],
    "de": ["Der Rechtsschutzversicherer schreibt, dass die Angstschweißflecken nicht ersetzt werden. Selbstverständlich widersprechen wir, denn die Frist ist längst verstrichen.", "Morgens um sechs fährt der erste Bus. Wer ihn verpasst, wartet eine Stunde, trinkt vielleicht einen Kaffee und liest die Zeitung von gestern."],
    "fr": ["Les enfants s'étaient endormis depuis longtemps quand l'orage éclata. Où étiez-vous donc, demanda-t-elle, alors que la fenêtre de la cuisine battait encore ?"],
    "es": ["La abuela guardaba las cartas en un cajón que nadie abría. Cuando murió, encontramos entre ellas un billete de tren a Lisboa, fechado en 1952 y sin usar."],
    "ru": ["Взгляд хозяйки задержался на чемодане. Всё-таки вы уезжаете, сказала она, и в комнате стало тихо; только часы продолжали идти как ни в чём не бывало.", "Поезд опаздывал на два часа, и пассажиры постепенно начали разговаривать друг с другом. К утру все уже знали, кто куда и зачем едет."],
    "pl": ["Strażnik przyszedł przed świtem i otworzył bramę. Źdźbła trawy lśniły od rosy, a wszystkie ptaki milczały, jakby czekały na pierwszy promień słońca."],
    "hi": ["बारिश के बाद गली में पानी भर गया था। बच्चे कागज़ की नावें बनाकर उसमें तैरा रहे थे और उनकी माँएँ दरवाज़े से उन्हें देख रही थीं।"],
    "ar": ["كان المطر ينزل منذ الصباح، والناس يحتمون تحت المظلات أمام المقهى. سألني النادل إن كنت أريد شايا آخر، فقلت له: لم لا، ما زال الوقت مبكرا."],
    "pt": ["A avó guardava as cartas numa gaveta que ninguém abria. Não sabíamos então que a mais antiga tinha sido escrita em São Tomé, durante a grande seca."],
    "vi": ["Bà ngoại cất những lá thư trong một ngăn kéo mà không ai mở. Khi bà mất, chúng tôi tìm thấy một tấm vé tàu cũ chưa từng được dùng."],
    "el": ["Η γιαγιά φύλαγε τα γράμματα σε ένα συρτάρι που κανείς δεν άνοιγε. Όταν πέθανε, βρήκαμε ανάμεσά τους ένα παλιό εισιτήριο για την Αλεξάνδρεια."],
    "ja": ["祖母は手紙を誰も開けない引き出しにしまっていた。亡くなったあと、その中から使われなかった古い切符が見つかった。"],
    "th": ["คุณยายเก็บจดหมายไว้ในลิ้นชักที่ไม่มีใครเปิด เมื่อท่านจากไป เราพบตั๋วรถไฟเก่าใบหนึ่งที่ไม่เคยถูกใช้"],
}
NOT_PROSE = {
    "list": ["Shopping:\n- milk\n- two loaves of bread\n- eggs\n- coffee filters\n- stamps", "1. Unpack the box\n2. Check the cable\n3. Plug it in\n4. Wait for the green light\n5. Press start", "Äpfel\nBirnen\nKartoffeln\nZwiebeln\nMehl\nSalz"],
    "table": ["name,qty,price\napple,3,1.20\npear,5,0.80\nplum,12,2.10\nfig,2,3.00", "| id | state | owner |\n|---|---|---|\n| 1 | open | ann |\n| 2 | done | bob |\n| 3 | open | eve |"],
    "junk": ["qwrtp zxcvb lkjhg mnbvc dfghj rtypl wqxzc kjhgf vbnmx plkjh tgbrf sdfgh zxmnb", "%%&$ ##@! ^^^ ((*&^ %%$ @@!~ ||} {{:> <>?/ ..;; ~~`` ++== __--", "9f 3c 00 1a ff e2 7b 44 90 0d 6e 8a 21 c3 5f b8 72 10 ee 4d 06 99 ab cd 3e", "na na na na na na na na na na na na na na na na na na na na", "tsx rhe  owlt fi nm hdse  eta l ortc ,sei h  nuoyt aw b e gnd  ri s  t ehmk o a  plvtr", "Q2hhcmxlcyBEYXJ3aW4gd2FzIG5vdCBoZXJlIHRvZGF5LCBidXQgaGlzIGJvb2tzIHdlcmUu0aVJx93Kd7Pq"],
}


def test_natural_texts_of_many_languages_are_prose(spark):
    texts = [(lang, t) for lang, ts in NATURAL.items() for t in ts]
    got = stats(spark, [t for _, t in texts], common=shipped_words(spark))
    assert [(lang, t[:30], s["form"]) for (lang, t), s in zip(texts, got) if s["form"] != "prose"] == []
    longer = stats(spark, [" ".join([t] * 3) + "\n\n" + t for _, t in texts])  # without common words of any language
    assert [(lang, t[:30], s["form"]) for (lang, t), s in zip(texts, longer) if s["form"] != "prose"] == []


def test_lists_tables_and_junk_are_told_apart(spark):
    texts = [(form, t) for form, ts in NOT_PROSE.items() for t in ts]
    got = stats(spark, [t for _, t in texts], common=shipped_words(spark))
    assert [(form, t[:30], s["form"]) for (form, t), s in zip(texts, got) if s["form"] != form] == []


def test_junk_rules_have_two_independent_signs():
    junk = [r for r in quality.load_rules()["rules"] if r["form"] == "junk"]
    assert junk and all(len({quality.SIGNS[n][1] for n, *_ in r["if"]} - {None}) >= 2 for r in junk)


def shipped_words(spark):
    import os

    from arrowlens.sources.tables import table

    sf = "/root/testdata/sf0.001"
    return quality.common_words(table(spark, sf, "common_word")) if os.path.isdir(sf) else COMMON


def test_precision_and_recall_on_other_documents(spark, sf):
    from arrowlens.llm.teacher import form_of
    from arrowlens.sources.tables import table

    got = quality.with_form(quality.statistics(table(spark, sf.replace("0.001", "0.01"), "documents"), shipped_words(spark), ("doc_id", "text"))).where("form IS NOT NULL").select("text", "form").collect()
    pairs = [(form_of(r.text), r.form) for r in got]
    for c in quality.CLASSES:
        found, true = [w for w, f in pairs if f == c], [f for w, f in pairs if w == c]
        assert found.count(c) >= 0.97 * len(found) and true.count(c) >= 0.97 * len(true), c
