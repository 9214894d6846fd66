import os
import random

import pytest

from mediatide.llm import residue as R
from mediatide.llm import residue_seeds as S

PROSE = ["The band moved to Dunholm in 1994, where they shared a kitchen and a mixing desk.", "Critics called it unfinished, which they took as praise.", "My copy skips at 8:45, the replacement file is fine.", "很多人是在dub的歌单里第一次听到他们的。", "副歌只唱了一遍，之后全是手风琴的长音。", "Auf der Hülle sieht man eine Brücke, gezeichnet von einer Nachbarin.", "На обложке мост, который нарисовала соседка.", "La portada muestra un tren pintado por una vecina del grupo.", "oh, the mirror knows\nand I mend the mirror home", "1. Fenêtre sans Problème 4:12\n02 Silver River 3:01", "track 6 says 39% done and then nothing 👍🏽"]


@pytest.fixture(scope="module")
def models():
    rnd = random.Random(1)
    return R.train([" ".join(rnd.choice(PROSE) for _ in range(rnd.randint(1, 6))) for _ in range(400)])


@pytest.mark.parametrize(
    "text",
    ["The band moved to {{city}} in 1994, where they shared a kitchen and a mixing desk.", "Critics called %ALBUM% unfinished, which [artist] took as praise.", "副歌只唱了一遍，之后全是${instrument}的长音。", "Critics called TBD unfinished, which they took as praise.", PROSE[0] + " Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
     "502 Bad Gateway", "Please enable JavaScript to continue.", "请启用 JavaScript 后继续访问。", "Fehler 404: Seite nicht gefunden", '{"code":500,"message":"参数错误","data":[]}', PROSE[1] + "\nTraceback (most recent call last):\n  File \"/srv/app/x.py\", line 7, in load", "这里是歌词的占位文字，请替换。", "Votre texte ici."],
)
def test_residue(models, text):
    assert R.inspect([text], models)[0] is not None


@pytest.mark.parametrize("text", [None, "", "  \n ", *PROSE, "The web player needs JavaScript, which every current browser has switched on; if you block scripts you can still export the list as text and read it offline.", "Templates for text export use {{title}} in the heading; leave them as they are, the tool puts in the real names of each list.", "In the last verse she sings that his heart is undefined, null and void, and the choir answers with a scripted error.", "lost the page for Silver River, anyone?"])
def test_prose(models, text):
    assert R.inspect([text], models)[0] is None


def test_neighbours_do_not_touch(models):
    got = R.inspect(["{{artist}}", PROSE[0], "x", "{{artist}}", PROSE[3]], models)
    assert [g is not None for g in got] == [True, False, False, True, False]


def test_frames(spark, models):
    rows = [(1, "404 Not Found", "k"), (1, "404 Not Found", "k"), (2, PROSE[0], "k"), (3, None, "k"), (4, PROSE[0] * 3000 + " {{artist_name}} ", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    shared = spark.sparkContext.broadcast(models)
    got = sorted((r.doc_id, r.start > 1000) for r in R.residue(df, "doc_id", "text", shared).collect())
    assert got == [(1, False), (1, False), (4, True)]
    assert R.residue(df.limit(0), "doc_id", "text", shared).count() == 0
    assert len(R.natural_sample(df, "doc_id", "text")) == 4


def test_stretches_of_endless_texts(models, monkeypatch):
    monkeypatch.setattr(R, "MOST_CHARS", 500)
    clean = (PROSE[0] + " ") * 100
    far = clean + " {{artist_name}} " + clean
    got = R.inspect([clean, far, PROSE[2]], models)
    assert got[0] is got[2] is None
    assert abs(got[1].start - len(clean)) < 20


@pytest.mark.parametrize("page", ["Access denied. You don't have permission to view this page.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."])
def test_residue_that_is_a_third_of_the_sample(page):
    rnd = random.Random(2)
    sample = [" ".join(rnd.choice(PROSE) for _ in range(rnd.randint(1, 6))) for _ in range(300)] + [page] * 150
    m = R.train(sample)
    assert R.inspect([page], m)[0] is not None
    assert R.inspect([PROSE[0]], m)[0] is None


def test_sample_holds_a_text_once(spark):
    rows = [(k, "404 Not Found" if k % 3 == 0 else f"{PROSE[0]} {k}") for k in range(30)] + [(31, None), (32, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = R.natural_sample(R.distinct_texts(df, "text"), "text_hash", "text")
    assert len(got) == len(set(got)) == 21
    assert R.distinct_texts(df.limit(0), "text").count() == 0


@pytest.mark.parametrize("notice", ["404 Not Found", "Access denied", "Please enable JavaScript to continue", "Lorem ipsum dolor sit amet, consectetur adipiscing elit"])
def test_notice_in_mid_sentence(models, notice):
    long = "The band moved to Dunholm in 1994, where they shared a kitchen and a mixing desk, and on the sleeve one sees a bridge"
    assert R.inspect([f"{long} - {notice} - {long[4:]}."], models)[0] is not None
    assert R.inspect([f"{long} - {long[4:]}."], models)[0] is None


def test_quoted_notice_does_not_reach_the_next_sentence(models):
    assert R.inspect(['The single "404 Not Found" by The Wandering Lanterns is a joke about a lost web page, but the tape loop part is lovely. ' + PROSE[0]], models)[0] is None


#: Residue and prose written apart from the seeds, of kinds and languages of all sorts.
HELD = ["DNS_PROBE_FINISHED_NXDOMAIN: the server IP address could not be found.","Der Proxyserver konnte die Anfrage nicht weiterleiten. Fehlercode 502.","Esta web usa cookies para mejorar su experiencia. Acepte para continuar.","<ul>{% for song in songs %}<li>{{ song }}</li>{% endfor %}</ul>","Vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor.","Bacon ipsum dolor amet pork belly ham hock, brisket jowl turkey.","未找到您要的资源 (错误代码 1005)","Page not found. The link you followed may be broken, or the page may have been removed.",
"Whitelabel Error Page. This application has no explicit mapping for /error, so you are seeing this as a fallback.","Internal Server Error. The server was unable to complete your request. More information may be available in the server error log.","Sorry, you have been blocked. You are unable to access this website.","Hmm. We’re having trouble finding that site.","Please turn JavaScript on and reload the page.","This page requires JavaScript to be enabled in your browser settings.","Diese Seite benötigt JavaScript. Bitte aktivieren Sie es in Ihrem Browser.","Cette application nécessite JavaScript pour fonctionner.","Esta aplicación requiere JavaScript para funcionar.","Для работы приложения необходимо включить JavaScript.","このアプリを実行するにはJavaScriptが必要です。","이 앱을 실행하려면 JavaScript가 필요합니다.","抱歉，您的浏览器没有开启 JavaScript，页面无法正常显示",
"Dear {{ customer_name }}, thank you for listening.","Hello ${user.firstName}, here is your mix.","The band was formed in %YEAR% in %CITY%.","专辑发行于{年份}年，由{厂牌}出品。","La banda se formó en [[ciudad]] en 1999.","Das Album erschien bei <LABEL> im Herbst.",
"Curabitur blandit tempus porttitor. Nulla vitae elit libero, a pharetra augue.","TODO: write description","Text goes here text goes here text goes here","Hier kommt noch ein Text hin.","Ici viendra le texte de présentation.","Aquí irá el texto de presentación.","Здесь скоро появится описание.","此处内容待补充","暂无内容，敬请期待","テキストが入ります。テキストが入ります。","여기에 내용이 들어갑니다.",
"Die gewünschte Seite existiert nicht oder wurde verschoben.","La page que vous recherchez est introuvable.","No hemos podido encontrar la página que buscaba.","Страница, которую вы ищете, не существует.","お探しのページは見つかりません。","요청하신 페이지를 찾을 수 없습니다.","您访问的页面出错了，请联系管理员","连接超时，请检查您的网络设置","服务器内部错误 500","Access to this page has been denied because we believe you are using automation tools.","Error: ECONNREFUSED 127.0.0.1:5432","java.lang.RuntimeException: Unable to resolve host","Notice: Trying to get property 'name' of non-object in /var/www/site/track.php on line 88","Rate limit reached. Please wait before sending further requests.","The service is unavailable."]
FINE = ["The choir met every Tuesday in a school gym and paid the organist in cake.","Listeners wrote in to say that the new single reminded them of rain on a tin roof.","Der Chor probte jeden Dienstag in einer Turnhalle.","Le chœur répétait chaque mardi dans un gymnase.","El coro ensayaba cada martes en un gimnasio.","Хор репетировал каждый вторник в спортзале школы.","合唱团每周二在学校体育馆排练。","合唱団は毎週火曜日に体育館で練習した。","합창단은 화요일마다 체육관에서 연습했다.","If the scan stops early, look at the log: it names the file that could not be read.","The singer said the error was hers, and apologised to the drummer on stage.","Her website lists all concerts; the page for tickets opens in May.","导出时可以选择文件名的格式，比如先写歌手再写歌名。","No JavaScript is needed to read this help page, but the player uses it.","He never found the page of the songbook that had the missing verse."]


DOCS = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DOCS), reason="no test tables")
def test_held_out_kinds_with_models_of_the_corpus(spark):
    docs = spark.read.parquet(DOCS)
    m = R.fit(docs, "doc_id", "text").value
    found = [f is not None for f in R.inspect(HELD, m)]
    assert sum(found) >= 0.9 * len(HELD)
    assert not any(R.inspect(FINE, m))


def test_seeds_and_held_out_texts_are_apart():
    seeds = "\n".join(S.errors() + S.fillers() + S.mentions() + R._rendered())
    assert [t for t in HELD + FINE if t in seeds] == []


@pytest.mark.skipif(not os.path.exists(DOCS), reason="no test tables")
def test_no_seed_stands_in_a_document():
    """But for the status lines of the public registry, which any page of such a kind holds."""
    import pyarrow.parquet as pq

    texts = "\n".join({t for t in pq.read_table(DOCS, columns=["text"]).column(0).to_pylist() if t})
    public = set(S.statuses())
    seeds = {t for t in S.errors() + S.fillers() + S.mentions() + S.lines(S.ORDINARY) if len(t) >= 12} - public
    assert [t for t in sorted(seeds) if t in texts] == []
