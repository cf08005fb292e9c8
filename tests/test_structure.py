import random
import re

from lexmesh.operators import chunks, sections


def test_articles(spark):
    text = ("Preámbulo, art. 5° del DFL 4.\n Artículo 1°.- Uno.\nArtículo 5 BIS.- Cinco bis.\nArtículo 1°.- Repetido.\n"
            " Artículo primero transitorio.- Final.\nARTÍCULO 7: Siete")
    df = spark.createDataFrame([("n", text), ("vacía", "")], "id_norma string, texto string")
    got = [(r["orden"], r["numero"]) for r in sections.articles(df, ["id_norma"]).orderBy("orden").collect()]
    assert got == [(0, "1°"), (1, "5 bis"), (2, "primero transitorio"), (3, "7")]


def test_short_articles_end_at_section(spark):
    text = "Artículo 1 " + "a" * 60 + "\nArtículo 2 corto\nArtículo 3 " + "b" * 60 + "\nTÍTULO II sobra"
    df = spark.createDataFrame([("n", text)], "id_norma string, texto string")
    got = {r["numero"]: r["texto"] for r in sections.short_articles(df, ["id_norma"]).collect()}
    assert set(got) == {"1", "3"} and not got["3"].endswith("sobra")


def test_short_articles_split_a_text_once(spark):
    """The number of pieces was asked for every piece, each time with the text made and split anew."""
    df = spark.range(1).selectExpr("cast(id as string) as id_norma", "concat('Artículo ', id, ' ', repeat('a', 60), '\n\n\u0001b\tc\u00a0\u000b d\u007f') as texto")
    found = sections.short_articles(df, ["id_norma"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(Art[íi]culo") == 1 and plan.count("Artículo ") == 1
    assert sections.short_articles(spark.createDataFrame([("n", None), ("m", "Artículo 1")], "id_norma string, texto string"), ["id_norma"]).count() == 0


def test_article_text_is_cleaned_as_by_the_pattern(spark):
    from lexmesh.functions.text import clean_article_text

    rng = random.Random(3)
    said = ["".join(rng.choice("ab \t\n\x0b\f\r\u00a0\x00\x1f\x7f\u2003") for _ in range(rng.randint(0, 12))) for _ in range(500)] + [None]
    got = [r.c for r in spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", clean_article_text("t").alias("c")).orderBy("i").collect()]
    assert got == [None if t is None else re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", re.sub("[ \t\n\x0b\f\r\u00a0]+", " ", t)).strip(" ") for t in said]


def test_structure(spark):
    text = ("TÍTULO I: GENERAL\nArtículo 1°.- Según la Ley 20.936 y el D.S. 62.\nDecreto 70, ENERGÍA\nArt. primero\nD.O. 05.06.2024\n"
            "TÍTULO II: FINAL\nArtículo 2°.- Nada.")
    df = spark.createDataFrame([("n", text)], "id_norma string, texto string")
    got = {r["numero"]: r for r in sections.structure(df, ["id_norma"]).collect()}
    assert got["1"]["en_titulo"] == "I" and got["2"]["en_titulo"] == "II"
    assert got["1"]["n_modificaciones"] == 1 and "D.O." not in got["1"]["texto"]
    assert set(got["1"]["citas"].split(",")) >= {"LEY_20936", "DECRETO_62"}


def reference_sentences(text, target=400, smallest=100, overlap=2):
    """What the packing must give, one text at a time."""
    if len(text.split()) <= target:
        return [text.strip()]
    units = [u.strip() for u in re.split(r"(?<=[.!?;])\s+(?=[A-ZÁÉÍÓÚÑa-z])", text) if u.strip()]
    if len(units) == 1 and len(units[0].split()) > 2 * target:
        words = units[0].split()
        units = [" ".join(words[i:i + target]) for i in range(0, len(words), target)]
    done, held = [], []
    for unit in units:
        if sum(len(u.split()) for u in held) + len(unit.split()) > target and sum(len(u.split()) for u in held) >= smallest:
            done.append(" ".join(held))
            held = held[-overlap:] + [unit]
        else:
            held.append(unit)
    if held and done and sum(len(u.split()) for u in held) < smallest:
        done[-1] += " " + " ".join(held)
    elif held:
        done.append(" ".join(held))
    return done


def test_sentence_chunks_against_brute_force(spark):
    random.seed(11)
    word = lambda: random.choice(["potencia", "firme", "de", "la", "línea"])
    sentence = lambda: (" ".join(word() for _ in range(random.randint(2, 60))).capitalize() + random.choice([".", ";", "!"]))
    texts = [" ".join(sentence() for _ in range(random.randint(1, 60))) for _ in range(30)]
    texts += ["a " * 400, "a " * 401, "b " * 801, "b " * 1300, "corto.", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in chunks.sentences(df, ["doc_id"]).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, text in enumerate(texts):
        assert got[i] == reference_sentences(text), i


def test_window_edges(spark):
    sizes = [0, 1, 399, 400, 401, 750, 751, 1100, 1101]
    df = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in sizes], "doc_id int, text string")
    got = {}
    for r in chunks.windows(df, ["doc_id"]).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["token_count"])
    for n in sizes:
        want, i = [], 0
        while n > 400:
            want.append(min(400, n - i))
            if i + 400 >= n:
                break
            i += 350
        assert got[n] == (want or [n]), n


def test_glossary_chunks(spark):
    text = "Se entenderá por:\na) Uno: primera cosa;\nb) Dos: segunda, art. 105° vale;\nc) sin dos puntos\nd) Tres: tercera;\n4. Cuatro: cuarta."
    df = spark.createDataFrame([("n", "2", text), ("n", "3", "se entenderá por: a) X: y")], "id_norma string, numero string, texto string")
    got = chunks.glossary_chunks(df, ["id_norma", "numero"]).orderBy("chunk_index").collect()
    assert [r["raw"] for r in got] == ["Se entenderá por:", "Uno: primera cosa", "Dos: segunda, art. 105° vale", "Tres: tercera", "Cuatro: cuarta."]
    assert got[1]["contextual"].startswith("[Artículo 2 de n] Definición en el glosario: «Uno». Uno:")


def test_siblings(spark):
    df = spark.createDataFrame(
        [("n", 0, "1", "x"), ("n", 1, "2", "según el artículo anterior y el artículo siguiente"), ("n", 2, "3", "artículo posterior")],
        "id_norma string, orden int, numero string, texto string")
    got = sorted((r["origen"], r["destino"], r["via"]) for r in sections.siblings(df).collect())
    assert got == [("2", "1", "precedente"), ("2", "3", "siguiente")]
