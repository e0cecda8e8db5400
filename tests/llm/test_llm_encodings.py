"""Clean texts of many languages are no cases; texts decoded wrongly are found and restored."""

import pytest

from tessera.llm import p1_encoding
from tessera.llm.p1_encoding import CONFUSED, Chain, Repairer, repair_html, repair_title, train_costs

#: Clean texts, divided by bars.
CLEAN = """
Škoda Fabia|GROSSE STRASSE ÄÖÜ|Þetta er íslenskur texti með ð og þ|«Ёлка»|Σίσυφος|ΩMEGA™ Watch|10 µm × 5 Ω|ÅÄÖ åäö Sverige|СССР и «СССР»|Сёмга и Сёстры
Рёв|«ВВС»|Институт «Г»|Příliš žluťoučký kůň úpěl ďábelské ódy|Türkiye'de güneşli bir gün, İstanbul ve Iğdır|Ελληνικά κείμενα για τη δοκιμή
Kæmi ný öxi hér, ykist þjófum nú bæði víl og ádrepa|Tiếng Việt có rất nhiều dấu thanh và chữ cái|Árvíztűrő tükörfúrógép|Ђорђе Ћирић и Љубица Њежић
Ђачки џеп|Съешь ещё этих мягких французских булок|България е страна на Балканите|Қазақстан Республикасы|Беларуская мова і ўсё астатняе|Ўзбекистон
Șțiință și tehnică în România|Žluté žáby|Čeština: háčky a čárky|Łódź, Kraków, Gdańsk|ÇOK GÜZEL|ÖVRIGT|ÄÄNEKOSKI|Øvre Årdal|Blåbærgrød på Læsø
Jürgen Müller & Söhne GmbH|naïve café façade résumé|L’œuvre d’Hélène|El Niño ¿qué pasó?|¡Olé!|São João da Fábrica|Õhtusöök jäääär
Latviešu valodā šķēršļi|Lietuvių kalba ąžuolas|מה שלומך היום|مرحبا بالعالم|नमस्ते दुनिया|สวัสดีชาวโลก|안녕하세요 세계|你好,世界|こんにちは世界|Հայաստան|საქართველო
E = mc² ≈ 9×10¹⁶ J|∑ x² ≤ ∞|5 °C – 10 °F|25 °C|±5 %|€100 £50 ¥1000|½ cup + ¾ tsp|π ≈ 3.14159|← Back|Next →|★★★★☆ rating|✓ done ✗ failed|🙂 smile
© 2024 Müller|® and ™ marks|§ 12 Abs. 3 BGB|№ 5|A → B ⇒ C|x₁ + x₂|ʃɪp ɪpə|mañana|Straße|STRASSE GRÖSSE|FRANÇAIS|ÉTÉ|À LA CARTE|ÑANDÚ|ПРИВЕТ МИР
НОВОСТИ ДНЯ|ОБЩИЙ РАЗДЕЛ|НОЧЬ|Ы|Й|ЙЦУКЕН|яблоко|Ґанок і їжак|ЄВРОПА|ЇЖАК|iPhone и iPad|SQL-запрос|C++ и Java-код|e-mail’ы|Москва—Петербург|«Ёж» и „Уж“
10 кг/м³|µTorrent|Ångström|Åse|Él|À|É|Ü|ö|ø|Żółw|Zażółć gęślą jaźń|ŻÓŁĆ|DŹWIĘK|Œuvre|cœur|“quoted” text|‘single’|„Deutsch“|«français»|» Danish «
…and more|—dash—|word—word|item·item|l’été|d’Été|x’y|Brenorßn|Brenorøn|Brenorån|Brenorčn|Brenorýn|Brenorðn|Brenorþn|Brenoræn|Brenorœn|Brenorżn|Brenorłn
Brenorşn|Brenorğn|Brenorőn|Brenorřn|Brenorâ|Brenorã|Brenorà|Brenorñ|Brenorÿ|Ñbrenor|Øbrenor|Åbrenor|Ærø|Œbren|Çabren|İbren|Şbren|Łbren|Đuro|Ðaldur|Þór
naïve: the ‘façade’|São Paulo – Über|Tamaß|Größe|Maße und Gewichte|Ça va?|où ça|Noël|Zoë|Chloë Brontë|Dvořák|Čapek|Antonín|Kieślowski|Lech Wałęsa
Björk Guðmundsdóttir|Reykjavík|Smörgåsbord|Ørsted|Malmö|Besançon|Curaçao|Córdoba|Málaga|Açaí|Pão de Açúcar|Avô e avó|coração|informação|Île-de-France
Hôtel-Dieu|Mâcon|Gruyère|Crème brûlée|Déjà vu|À bientôt|Ô temps|façade|garçon|«Garçon»|100 000 ₽|5 ′ 6 ″|H₂O|CO₂|naïveté|coöperate|Dürüm döner|Gözleme
ça|là|où|dès|à|á|ó|í|ú|é|è|ù|û|ê|ë|ï|ü|ö|ä|ß|ñ|ç|ã|õ|å|ø|æ|š|č|ž|ř|ě|ů|ő|ű|ł|ą|ę|ś|ć|ń|ż|ź|ș|ț|ă|î|ğ|ı|ş|İ|Цена: 5 руб.|«Новая газета»|Ёж|ёлка|ещё|её
моё|Её|ЕЁ|всё ещё|Юг|Ящик|Эхо|Щука|Ґ|Є|І|Ї|Чёрт|Её счёт|ЧЕРТЁЖ|СЧЁТ|РЁБРА|СЁСТРЫ|Установка Gitа и Gitу|Вызов APIи через URLы и JSONом|Installation¶
Smith‡|Smith†|don´t|l´été|n° 5|a×b|x±y|A→B|BäckerÖko GmbH|Nº 5|Mª José|20 °C|СЁМГА|Сёла|Рёбра
"""

#: Clean sentences of the languages the model knows, long enough to show their letters.
SENTENCES = {
    "ru": "Внимательный читатель проверяет первый заголовок после короткой сводки",
    "uk": "Архівна служба відновлює наступні сторінки після першої спроби",
    "de": "Die Prüferin lädt das endgültige Menü für die nächsten Schnappschüsse",
    "fr": "La requête périmée est masquée après une très courte réponse tronquée",
    "es": "El número de páginas vacías está en la última sección del menú público",
    "pt": "A comparação dos esboços não está na próxima página do calendário público",
    "pl": "Zagnieżdżone tabele są w następnej części krótkiego dziennika odnośników",
    "ja": "注意深い読者は次のページの短いまとめを確認します",
}


@pytest.fixture(scope="module")
def repairer():
    import pandas as pd

    return Repairer(train_costs(pd.read_parquet("/root/testdata/sf0.001/lang_samples.parquet")["sample_text"]))


def garbled(text: str, chain: Chain, repairer: Repairer) -> str | None:
    """``text`` written in one encoding and read as the other; None if it cannot be written."""
    back = {byte: chr(point) for point, byte in repairer.tables[chain.read].items()}
    try:
        return "".join(back.get(byte, chr(byte)) for byte in text.encode(chain.written))
    except UnicodeEncodeError:
        return None


@pytest.mark.parametrize("text", [t for line in CLEAN.strip().splitlines() for t in line.split("|")])
def test_clean_texts_are_no_cases(repairer, text):
    assert repair_title(text, repairer) is None
    assert repair_html(f"<p>{text.replace('&', '&amp;')}</p>", repairer) is None


@pytest.mark.parametrize("lang", SENTENCES)
def test_every_utf8_layer_is_undone(repairer, lang):
    for chain in (Chain(read, written) for written_as, read_as in CONFUSED[:1] for written in written_as for read in read_as):
        text = garbled(SENTENCES[lang], chain, repairer)
        restored, layers, whole = repair_title(text, repairer)
        assert restored == SENTENCES[lang] and whole and len(layers) == 1 and layers[0].startswith("utf_8 read as ")


@pytest.mark.parametrize(("lang", "written", "read"), [
    ("ru", "cp1251", "koi8_r"), ("ru", "koi8_r", "cp1251"), ("ru", "cp866", "cp1251"), ("ru", "cp1251", "cp1252"), ("ru", "iso8859_5", "cp1251"), ("uk", "koi8_u", "cp1251"),
    ("de", "cp1252", "mac_roman"), ("de", "mac_roman", "cp1252"), ("de", "cp1252", "cp1251"), ("de", "cp850", "cp1252"), ("fr", "cp850", "cp1252"), ("fr", "mac_roman", "cp1252"),
    ("es", "cp1252", "cp850"), ("pt", "mac_roman", "cp1252"), ("pl", "cp1250", "cp1252"), ("pl", "iso8859_2", "cp1252"), ("ja", "shift_jis", "cp1252"), ("ja", "euc_jp", "cp1252"),
])
def test_code_pages_read_as_others_are_found_and_restored(repairer, lang, written, read):
    text = garbled(SENTENCES[lang], Chain(read, written), repairer)
    restored, layers, _ = repair_title(text, repairer)
    same = sum(a == b for a, b in zip(restored, SENTENCES[lang]))
    assert layers and same >= 0.9 * len(SENTENCES[lang])


@pytest.mark.parametrize(("text", "restored"), [
    ("TirpelbrinÃ©: the plain title", "Tirpelbriné: the plain title"), ("Lunorзn | a quiet corner", "Lunorçn | a quiet corner"), ("Ravtok‚n‚: the adapter", "Ravtokéné: the adapter"),
    ("OsulmartokŽ: the page", "Osulmartoké: the page"), ("A caf‚ near the host", "A café near the host"), ("The ≈ngstrˆm panel", "The Ångström panel"), ("The outline â€“ a summary", "The outline – a summary"),
])
def test_single_words_amid_clean_text_are_restored(repairer, text, restored):
    assert repair_title(text, repairer)[0] == restored


def test_letters_whose_bytes_are_lost_make_a_case_that_is_not_whole(repairer):
    assert repair_title("One slow host â the visible text", repairer) == ("One slow host â the visible text", [], False)


def test_all_rows_of_the_samples_train_the_model(spark, repairer, monkeypatch):
    known = spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet").select("sample_text")
    english = spark.range(20_000).selectExpr("'The plain outline of a page' AS sample_text")
    samples = english.unionByName(known)
    bad = garbled(SENTENCES["ru"], Chain("cp1251", "koi8_r"), repairer)
    rows = spark.createDataFrame([(1, bad)], "page_id BIGINT, title STRING")
    assert [r.restored for r in p1_encoding.find_garbled(rows, "page_id", "title", samples, html=False).collect()] == [SENTENCES["ru"]]

    # counts of the workers, and counts in parts, are those of all sentences read at once
    texts = [r[0] for r in samples.collect()]
    once = train_costs(texts)
    monkeypatch.setattr(p1_encoding, "COUNTED", 50)
    for costs in (p1_encoding.trained_costs(samples), train_costs(texts)):
        assert costs.single == once.single and costs.unknown == once.unknown
        assert costs.pairs.codes.tolist() == once.pairs.codes.tolist() and costs.pairs.bits.tolist() == once.pairs.bits.tolist()
    assert once.pairs["Th"] < 4 and once.pairs["qЖ"] is None
