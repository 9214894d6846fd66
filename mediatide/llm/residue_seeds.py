"""Seed texts for the residue models, written from the kinds of residue there are and put together by rule.

Status pages come from the public registry of HTTP statuses, filler from the vocabulary that generators of dummy
Latin draw on, notices from patterns and the things they speak of, per language. None of it is taken from the
documents that are judged; ``tests/llm/test_residue.py`` asserts that no line stands in any of them.
"""

from __future__ import annotations

import random
from http import HTTPStatus

# fixed values: for each language what notices speak of, and how they say it ({x}: the thing, {n}: a number)
THINGS = {
    "en": "page|site|content|file|resource|document|profile|album page|playlist|song page|lyrics page|comment section|web player|video|account|list|track page|result",
    "de": "Seite|Datei|Inhalt|Ressource|Liste|Albumseite|Website|Sammlung|Wiedergabeliste|Konto",
    "fr": "page|fichier|contenu|ressource|liste de lecture|page de l'album|site|vidéo|compte",
    "es": "página|archivo|contenido|recurso|lista de reproducción|página del álbum|sitio|vídeo|cuenta",
    "ru": "страница|файл|ресурс|список воспроизведения|страница альбома|материал|раздел|запись|профиль",
    "zh": "页面|网页|内容|文件|资源|歌单|专辑页|歌手页|歌词|评论|视频|账号|链接|播放器",
    "ja": "ページ|ファイル|コンテンツ|リソース|プレイリスト|動画|アルバムのページ|歌詞|アカウント",
    "ko": "페이지|파일|콘텐츠|자료|재생 목록|동영상|앨범 페이지|가사|계정",
}
ERRORS = {
    "en": "The {x} you followed a link to is missing.|We could not find the {x} you wanted.|This {x} can't be found|The {x} could not be loaded. Please retry.|Unable to load the {x}.|Failed to load {x}: server did not respond|The {x} you have requested has been moved or deleted.|The link may be broken, or the {x} may have been removed.|The {x} is no longer online.|Sorry, this {x} isn't available right now.|This {x} cannot be viewed in your region or country.|Due to rights restrictions this {x} is unavailable where you are.|You must sign in before you can see this {x}.|You are not authorized to open the {x}.|You don't have access to this {x}.|Permission denied while opening the {x}.|This {x} is private or was deleted by its owner.|The owner has made this {x} private.|The {x} is under maintenance, come back soon.",
    "en.": "Page not found.|Page does not exist|Nothing was found at this address.|Check the address and try again.|An error has occurred.|An internal error occurred while your request was processed.|Something has gone wrong on the server.|Oops, that did not work.|Whoops, looks like something went wrong!|We're having trouble, please come back in a few minutes.|Try again in {n} minutes.|Please wait {n} seconds and retry.|Retry after {n} seconds.|The server is temporarily unable to service your request due to maintenance downtime or capacity problems.|The server encountered an unexpected condition.|The server is too busy.|The site is down for scheduled maintenance.|The upstream server returned an invalid response.|The gateway did not receive a timely response from the upstream server.|The proxy server could not handle the request.|No response from the backend (timeout after {n} ms)|upstream connect error or disconnect/reset before headers|Connection timed out after {n} seconds|Connection reset by peer|The connection to the server was lost.|Could not connect to the database.|Error establishing a database connection|Database connection failed|Your connection was interrupted.|This site can't be reached|The requested address took too long to respond.|DNS address could not be found. ERR_NAME_NOT_RESOLVED|ERR_CONNECTION_TIMED_OUT|ERR_TOO_MANY_REDIRECTS|NET::ERR_CERT_DATE_INVALID|Your login has timed out. Sign in again.|Session timed out, log in again|Your session is no longer valid.|You have been logged out.|Login required|Access to this resource on the server is denied!|You do not have the rights to see this.|Your IP address has been blocked.|Your IP was limited because of too many requests.|You have sent too many requests in a given amount of time.|Rate limit exceeded, slow down|API quota exceeded|We have detected unusual traffic from your network.|Please complete the captcha to prove that you are not a robot.|Prove that you're human|Verifying you are human. This may take a few seconds.|Checking if the site connection is secure|Checking your browser before accessing the site.|Performance and security by the proxy. Ray ID: 7f{n}ab|Reference #18.{n}.16|Incident id: {n}-c0ffee|Request id: 8d{n}fe|(reference: e{n}b)|error code {n}|Error number {n}|(error {n})|status code: {n}|Additionally, a {n} error occurred while trying to use an ErrorDocument to handle the request.|The requested resource could not be served by this host.|Return to the homepage|Menu ¦ Home ¦ Albums ¦ Charts ¦ Login ¦ Help|Home ¦ Artists ¦ Playlists ¦ Contact|Start > Music > Lists|All rights reserved. Terms ¦ Privacy ¦ Imprint|Go back to the start page|Contact the administrator if the problem persists.|Apache Server at localhost Port 80|nginx/1.18.0|openresty|cloudflare|The removed account's lists can't be shown.|This account has been suspended|The license for this title has expired|Not available in your country",
    "de": "Die {x} wurde hier nicht gefunden.|Die angegebene {x} existiert nicht mehr.|{x} konnte nicht geladen werden.|{x} ist zurzeit nicht erreichbar.|Sie haben keine Berechtigung, diese {x} zu sehen.|Diese {x} wurde gelöscht oder ist privat.|{x} in Ihrem Land nicht verfügbar",
    "de.": "Fehler {n}|Serverfehler {n}|Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später noch einmal.|Der Server antwortet nicht.|Der Proxyserver hat keine Antwort erhalten.|Zeitüberschreitung der Anfrage|Zugriff nicht erlaubt|Ihre Sitzung ist abgelaufen, bitte melden Sie sich erneut an.|Zu viele Anfragen, bitte warten Sie {n} Sekunden.|Wegen Wartungsarbeiten vorübergehend geschlossen|Leider ist etwas schiefgelaufen.|Ungültige Anfrage|Verbindung fehlgeschlagen|Zur Startseite",
    "fr": "La {x} est introuvable ici.|Impossible de charger : {x}|La {x} que vous cherchez n'existe plus.|Ce {x} a été supprimé ou déplacé.|Vous n'avez pas accès à : {x}|{x} non disponible dans votre pays|Désolé, {x} indisponible pour le moment",
    "fr.": "Erreur {n}|Erreur serveur {n}|Une erreur est survenue, veuillez réessayer plus tard.|Le serveur ne répond pas.|Le serveur mandataire n'a reçu aucune réponse.|Délai d'attente dépassé|Accès interdit|Votre session a expiré, reconnectez-vous.|Trop de requêtes, patientez {n} secondes.|Site en maintenance|Oups, quelque chose s'est mal passé.|Requête invalide|Échec de la connexion|Retour à l'accueil|Ce service est temporairement hors ligne",
    "es": "La {x} no fue encontrada|El {x} no fue encontrado|No se pudo cargar: {x}|La {x} que busca ya no existe.|Este {x} fue eliminado o movido.|No tiene permiso para ver: {x}|{x} no disponible en su país|Lo sentimos, {x} no disponible por ahora",
    "es.": "Error {n}|Error del servidor {n}|Se ha producido un error, inténtelo de nuevo más tarde.|El servidor no responde.|El servidor proxy no recibió respuesta.|Tiempo de espera agotado|Acceso prohibido|Su sesión ha caducado, inicie sesión de nuevo.|Demasiadas solicitudes, espere {n} segundos.|Sitio en mantenimiento|Vaya, algo salió mal.|Solicitud no válida|Fallo de conexión|Volver al inicio|Este servicio está fuera de línea",
    "ru": "Такая {x} не была найдена|{x} не был найден|Не удалось загрузить: {x}|Запрашиваемая {x} удалена или перемещена.|Нет прав на просмотр: {x}|{x} недоступна в вашей стране|К сожалению, {x} сейчас недоступна",
    "ru.": "Ошибка {n}|Ошибка сервера {n}|Произошла ошибка, попробуйте ещё раз позже.|Сервер не отвечает.|Прокси-сервер не получил ответа.|Время ожидания истекло|Доступ закрыт|Сессия истекла, войдите снова.|Слишком много запросов, подождите {n} секунд.|Сайт на техническом обслуживании|Упс, что-то пошло не так.|Неверный запрос|Не удалось установить соединение|На главную|Сервис сейчас недоступен",
    "zh": "找不到{x}|抱歉，您要看的{x}迷路了，回首页吧。|哎呀，{x}走失了，返回首页看看|{n} 没有这个{x}|{n} 错误：{x}不存在|请先通过安全验证，再继续查看{x}|完成验证后才能浏览{x}|{n}：{x}不存在|{n} 该{x}不存在|{n} 找不到{x}|网络出错，{x}加载不了，点此重试|未找到该{x}|没有找到您要的{x}|{x}不存在|您要找的{x}已删除|您要访问的{x}不见了|很抱歉，{x}已下线|{x}加载出错，请刷新|{x}无法显示|{x}暂时无法访问|您无权访问该{x}|{x}需要登录才能查看|{x}已被作者删除或设置为私密|由于版权限制，{x}在您所在地区不可用|{x}暂时不可播放|{x}维护中",
    "zh.": "错误代码 {n}|（错误代码 {n}）|错误 {n}|错误码{n}|HTTP 状态 {n}|服务器错误|服务器内部发生错误|服务器繁忙，请稍后重试|服务器正在维护|系统错误，请重试|系统异常|网络错误，请检查网络后重试|网络连接超时|网络不给力，点击重新加载|请求失败|请求超时|请求过多，请稍候|操作太频繁了，请{n}秒后再来|访问次数过多，请{n}秒后重新访问|访问频率太高，{n}秒后再试|访问受限|访问被拒绝|没有权限|登录超时，请重新登录|登录状态已失效|请先登录|请输入验证码|请完成人机验证|正在进行安全检查，请稍等|请求编号 {n}ab|出错了|哎呀，出错了|非常抱歉，出了点问题|回到首页|返回上一页|首页 分类 排行 注册|数据库连接失败|参数无效|接口返回异常|代理没有收到服务器的响应|网关错误|无法连接到服务器",
    "ja": "{x}が見つかりませんでした|お探しの{x}は存在しません。|{x}は削除されたか移動しました。|{x}を読み込めませんでした。|この{x}を表示する権限がありません。|{x}は現在ご利用いただけません。|お住まいの地域では{x}をご覧いただけません。",
    "ja.": "エラー {n}|エラーコード：{n}|サーバー内部エラー|サーバーが応答しません。|エラーが発生しました。時間をおいて再度お試しください。|接続がタイムアウトしました|アクセス権がありません|セッションの有効期限が切れました。再度ログインしてください。|リクエストが多すぎます。{n}秒後にお試しください。|メンテナンス中です|問題が発生しました|不正なリクエスト|接続に失敗しました|トップへ戻る|サービスを一時停止しています",
    "ko": "{x}를 찾을 수 없음|요청하신 {x}가 없습니다.|{x}가 삭제되었거나 이동되었습니다.|{x}를 불러오지 못했습니다.|{x}를 볼 권한이 없습니다.|현재 {x}를 이용할 수 없습니다.|해당 지역에서는 {x}를 이용할 수 없습니다.",
    "ko.": "오류 {n}|오류 코드: {n}|내부 서버 오류|서버가 응답하지 않습니다.|오류가 발생했습니다. 잠시 후 다시 시도해 주세요.|연결 시간이 초과되었습니다|권한이 없습니다|세션이 만료되었습니다. 다시 로그인해 주세요.|요청이 너무 많습니다. {n}초 후에 다시 시도하세요.|점검 중입니다|문제가 생겼습니다|잘못된 요청|연결에 실패했습니다|홈으로 돌아가기|서비스를 일시적으로 사용할 수 없습니다",
}
# fixed values: how languages and tools report failures of a program
TRACES = """
Traceback (innermost last)|  File "app/main.py", line {n}, in <module>|  File "/usr/lib/python3/site.py", line {n}, in render|    return self.get(key)|IndexError: list index out of range|AttributeError: 'NoneType' object has no attribute 'title'|KeyError: 'title'|TypeError: unsupported operand type(s)|UnicodeDecodeError: 'utf-8' codec can't decode byte|ConnectionError: HTTPConnectionPool|RuntimeError: maximum recursion depth exceeded
Fatal error: Uncaught Error: Call to undefined function get_title() in /var/www/html/index.php:{n}|Parse error: syntax error, unexpected end of file in /var/www/html/page.php on line {n}|Notice: Undefined index: artist in /home/www/list.php on line {n}|Warning: mysqli_connect(): Access denied for user|Fatal error: Allowed memory size of {n} bytes exhausted in /var/www/song.php on line {n}|thrown in /var/www/html/lib.php on line {n}
Exception in thread "worker-{n}" java.lang.IllegalStateException|at org.example.web.Handler.handle(Handler.java:{n})|Caused by: java.io.IOException: Broken pipe|java.lang.OutOfMemoryError: Java heap space|Unhandled Promise Rejection: ReferenceError: player is not defined|TypeError: undefined is not a function|TypeError: Cannot read property 'name' of null|SyntaxError: Unexpected token < in JSON at position 0|at Object.<anonymous> (/app/server.js:{n}:13)|panic: runtime error: invalid memory address or nil pointer dereference|goroutine {n} [running]:|Segmentation fault (core dumped)
ORA-00942: table or view does not exist|ERROR 1045 (28000): Access denied for user|You have an error in your SQL syntax near|SQLSTATE[42S02]: Base table or view not found|psycopg2.OperationalError: could not connect to server
{"status":{n},"error":"Service failure","path":"/api/songs"}|{"errors":[{"message":"Rate limited","code":{n}}]}|{"success":false,"code":{n},"msg":"请求失败","data":null}|{"ok":false,"description":"Bad request"}|{"ret":{n},"msg":"token expired"}|<error><code>AccessDenied</code><message>Denied</message></error>|<title>Error {n}</title>|<h2>{n} - File or directory not found.</h2>|<hr><address>Apache Server</address>|<center><h2>Gateway error</h2></center><hr><center>openresty</center>
"""
SCRIPTS = {
    "en": "Enable JavaScript to view the {x}.|Without JavaScript this {x} shows nothing, sorry.|Sorry, but this {x} is empty without scripts.|JavaScript must be switched on to load the {x}.|This {x} works only with JavaScript.|The {x} does not work without JavaScript enabled.|Please allow scripts so that the {x} can load.|To see the {x}, activate JavaScript and cookies in the browser settings.|Your browser has JavaScript turned off, the {x} can't be displayed.|Without scripts the {x} remains blank.|We use cookies on this {x}. Accept all or manage your choices.|Your browser is out of date and can't show the {x}. Upgrade it.|Scripts are blocked, so the {x} cannot start.|The {x} requires a browser with script support.",
    "en.": "JavaScript is not enabled|JavaScript appears to be disabled.|JavaScript required|Please activate JavaScript.|Turn on cookies and reload.|Please disable your ad blocker to go on.|This browser is no longer supported.|Loading... Please wait|Accept cookies to continue|We and our partners use cookies. Accept|Reload once scripts are allowed.|noscript",
    "de": "JavaScript muss aktiviert sein, damit {x} geladen wird.|Ohne JavaScript kann {x} nicht angezeigt werden.|Erlauben Sie Skripte, um {x} zu öffnen.|Ihr Browser unterstützt kein JavaScript, {x} bleibt leer.",
    "de.": "Bitte schalten Sie JavaScript ein.|JavaScript ist nicht aktiv.|Wir verwenden Cookies. Alle akzeptieren|Ihr Browser ist veraltet.",
    "fr": "JavaScript doit être activé pour afficher : {x}|Sans JavaScript, {x} ne s'affiche pas.|Autorisez les scripts pour charger : {x}|Votre navigateur n'accepte pas les scripts, {x} reste vide.",
    "fr.": "Merci d'activer JavaScript.|JavaScript est désactivé.|Nous utilisons des cookies. Tout accepter|Votre navigateur est obsolète.",
    "es": "JavaScript debe estar activado para mostrar: {x}|Sin JavaScript no se puede ver: {x}|Permita los scripts para cargar: {x}|Su navegador no ejecuta scripts, {x} queda vacía.",
    "es.": "Por favor, habilite JavaScript.|JavaScript está desactivado.|Este sitio utiliza cookies propias y de terceros. Aceptar|Su navegador está desactualizado.|Al continuar navegando acepta el uso de cookies.",
    "ru": "Чтобы открыть раздел ({x}), включите JavaScript в настройках.|Без JavaScript {x} не отображается.|Разрешите выполнение скриптов: {x}|Браузер не поддерживает скрипты, {x} не загрузится.",
    "ru.": "Пожалуйста, включите JavaScript.|JavaScript отключён.|Мы используем файлы cookie. Принять|Ваш браузер устарел.",
    "zh": "请打开 JavaScript 后查看{x}|浏览器禁用了脚本，{x}打不开|需要启用脚本才能显示{x}|未启用 JavaScript，{x}无法正常加载|请允许脚本和 Cookie，否则{x}不能加载|请升级浏览器后再查看{x}",
    "zh.": "请启用JavaScript|JavaScript 已被禁用|您的浏览器不支持脚本|请开启 Cookie|浏览器版本太旧，请升级|本站使用 Cookie，点击接受|正在加载，请稍候",
    "ja": "{x}を見るにはJavaScriptをオンにしてください。|スクリプトが無効なため{x}を表示できません。|JavaScriptを許可しないと{x}は読み込まれません。",
    "ja.": "JavaScriptが無効になっています。|JavaScriptをオンにして再読み込みしてください。|お使いのブラウザは古いため対応していません。|Cookieの使用に同意する",
    "ko": "{x}를 보려면 JavaScript를 켜 주세요.|스크립트가 꺼져 있어 {x}를 표시할 수 없습니다.|JavaScript를 사용하도록 설정해야 {x}가 열립니다.",
    "ko.": "JavaScript가 꺼져 있습니다.|자바스크립트를 사용 설정하세요.|지원되지 않는 브라우저입니다.|쿠키 사용에 동의합니다",
}
# fixed values: what is left empty ({x}: the field), and words that stand for a text to come
FIELDS = {
    "en": "title|text|description|biography|album notes|lyrics|comment|paragraph|summary|caption|content|name", "de": "Titel|Text|Beschreibung|Biografie|Liedtext|Inhalt", "fr": "titre|texte|description|biographie|paroles|contenu", "es": "título|texto|descripción|biografía|letra|contenido",
    "ru": "название|текст|описание|биография|комментарий|содержание", "zh": "标题|文字|简介|介绍|描述|歌词|评论|正文|歌手介绍|歌单说明|内容", "ja": "タイトル|文章|説明|本文|歌詞|紹介文", "ko": "제목|글|설명|본문|가사|소개",
}
FILLER = {
    "en": "Enter the {x} here.|Put your {x} here|{x} will be added later.|{x} coming later|{x} to follow|Placeholder for the {x}|This is placeholder {x}.|This {x} is only a placeholder, please replace it.|Example {x} for testing purposes.|Dummy {x}, do not publish.|Write a short {x} in this box.|No {x} yet.|Just a test {x}, delete it before going live.|[{x} pending]|Replace with the final {x}|Testing the {x} field, ignore this.|Type your {x} in here",
    "en.": "dummy dummy dummy|this is a test this is a test|test text test text test text|testing testing one two three|word word word word word word|sample sample sample|qwerty qwerty qwertyuiop|asdfgh jkl asdfgh jkl|asdf jklö asdf jklö|asdf hjkl asdf|qwer uiop qwer|zxcv bnm zxcv bnm|abc abc abc xyz xyz|blah bleh blah bleh|foo foo bar bar baz|Hello world|more text to come|under construction|to be written|Bacon ham pork belly brisket jowl turkey sausage ribeye, filler meat filler|cupcake dessert icing candy sweet roll filler|The quick brown fox jumps over the lazy dog",
    "de": "Hier {x} eingeben|Bitte {x} eingeben.|Bitte {x} hier einsetzen|Bitte hier einen {x} einfügen|{x} folgt|{x} wird noch ergänzt|Platzhalter: {x}|Das ist nur ein Beispiel ({x}), bitte austauschen.|Muster: {x}, nicht veröffentlichen", "de.": "Blindtext Blindtext Blindtext|Dies ist ein Typoblindtext.|Mustertext|Test Test Test",
    "fr": "Saisissez ici : {x}|{x} à venir plus tard|{x} à rédiger|Emplacement réservé : {x}|Ceci est un exemple ({x}), à remplacer.|Faux {x}, ne pas publier", "fr.": "faux texte faux texte|Texte d'exemple|texte de remplissage|essai essai essai",
    "es": "Escriba aquí: {x}|{x} próximamente|{x} por redactar|Espacio reservado: {x}|Esto es un ejemplo ({x}), reemplácelo.|{x} de prueba, no publicar", "es.": "texto de prueba texto de prueba|texto simulado|prueba prueba prueba",
    "ru": "Введите сюда: {x}|Здесь будет {x}|Тут должно стоять {x}.|Здесь должно быть: {x}|{x} появится позже|{x} в разработке|Заглушка: {x}|Это пример ({x}), его нужно заменить.|Тестовое поле: {x}, не публиковать", "ru.": "рыба-текст рыба-текст|тест тест тест|образец текста|текст-рыба для макета",
    "zh": "请填写{x}|（这里填写{x}）|（此处填入{x}）|（{x}）占位文字|占位文字：{x}，请换掉|这里放{x}的占位文字|在这里填写{x}|这里填{x}|{x}待补充|{x}待完善|{x}稍后添加|暂时没有{x}|这里是{x}占位|{x}占位符，发布前替换|{x}示例，请勿发布|测试用的{x}，请删除|请替换这里的{x}|此处为{x}样例", "zh.": "测试测试|测试文本测试文本|占位占位占位|样例文字样例文字|示例示例示例示例|内容内容内容内容|填充填充填充填充|文字文字文字文字|测试数据，勿删|此处省略|待编辑|填充文字填充文字",
    "ja": "ここに{x}を入力|{x}は後で追加します。|{x}のダミーです。|仮の{x}です。差し替えてください。|{x}の例です。公開しないでください。", "ja.": "ダミー ダミー ダミー|テストテストテスト|仮テキスト|文章が入ります文章が入ります|あのイーハトーヴォのすきとおった風、ダミー",
    "ko": "여기에 {x}을 입력|{x}은 나중에 추가됩니다.|{x} 자리입니다.|임시 {x}이니 바꿔 주세요.|{x} 예시, 게시하지 마세요.", "ko.": "더미 텍스트 더미 텍스트|테스트 테스트 테스트|임시 문구|샘플 글입니다",
}
# fixed values: the vocabulary of dummy Latin
LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vivamus sagittis lacus vel augue laoreet rutrum faucibus auctor fusce dapibus tellus ac cursus
tortor mauris condimentum nibh fermentum massa justo maecenas sed diam eget risus varius blandit donec id elit non mi porta gravida at metus integer posuere erat ante venenatis vestibulum morbi leo porta nullam quis aenean lacinia bibendum consectetur cras mattis purus
praesent commodo scelerisque nisl phasellus pellentesque habitant senectus netus malesuada fames turpis egestas curabitur tempus sollicitudin ultrices vulputate suspendisse potenti quisque porttitor sem felis hendrerit aliquam etiam interdum orci
ut perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta explicabo nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur
magni dolores eos ratione sequi nesciunt neque porro quisquam dolorem adipisci numquam eius modi tempora incidunt magnam quaerat minima nostrum exercitationem corporis suscipit laboriosam consequatur vel eum iure quam nihil molestiae illum quo fugiat at vero accusamus
iusto dignissimos ducimus blanditiis praesentium voluptatum deleniti atque corrupti quos quas molestias excepturi occaecati cupiditate provident similique mollitia animi harum quidem rerum facilis expedita distinctio nam libero tempore cum soluta nobis eligendi optio
cumque impedit minus quod maxime placeat facere possimus assumenda repellendus temporibus quibusdam officiis debitis necessitatibus saepe eveniet voluptates repudiandae recusandae itaque earum hic tenetur sapiente delectus reiciendis voluptatibus maiores alias perferendis doloribus asperiores repellat
"""
# fixed values: how names of fields are written in templates, the fields, and what an empty one leaves behind
SLOTS = """artist artistName artist_name singer performer ARTIST album albumName album.title ALBUM title TITLE track.name track.title songName song_title name year YEAR release_year place PLACE city location LOCATION birth_place instrument INSTRUMENT count copies num NUM NUMBER date label genre user.name product.name company price email firstName 年份 专辑 歌手 歌名 城市 乐器 姓名""".split()
STYLES = ["{{%s}}", "{{ %s }}", "{{{%s}}}", "{%s}", "${%s}", "#{%s}", "<%%= %s %%>", "%%%s%%", "[[%s]]", "[%s]", "<%s>", "__%s__", "[insert %s here]", "INSERT %s HERE", "{{%s|default}}", "{%% %s %%}", "{%% if %s %%}", "{%% for x in %s %%}", "{%% endif %%}%s{{", "{{#each %s}}", "*|%s|*", "«%s»", "$%s$", "&lt;%s&gt;", "<%s goes here>", "[%s?]", "[Your %s]", "(%s to be added)", "%%(%s)s", "<?php echo $%s; ?>", "@Model.%s", "<%%- %s %%>", "{!%s!}", "[%%%s%%]"]
MARKS = ["XXXX", "TBD", "TODO", "undefined", "[object Object]", "______", "???", "?????", "N/A", "None", "null", "%s", "NaN"]

# fixed values: prose that speaks about such things; {title} stands for a slot that is quoted, {e} for a failure
MENTIONS = """
The player on the web page relies on JavaScript, which is on by default in current browsers; those who prefer to block scripts may save the list as plain text instead.|The preview on the start page needs scripts; whoever has switched JavaScript off in the browser can export every list as a file and read it without a connection.|Most of the tool works without JavaScript, which only the player uses, so you can leave scripts blocked and still read every list.|The web version uses JavaScript for the player only; every browser of the last years has it, and a list can be exported and read offline in any case.|Scripts are only needed for the preview, everything else on the help page can be read without them.|Why does the preview ask for scripts? Because the sound is mixed in the browser; the export works without that.
播放器要用 JavaScript，一般的浏览器都默认打开；不想打开，也可以把歌单导出成文本，离线再看。|网页试听需要脚本支持，大多数浏览器默认就是开启的；如果不想开启，可以把歌单导出成文本。|网页版播放器用到 JavaScript，浏览器一般默认已经打开；不愿意打开的话，也能把歌单导出后离线阅读。|试听页用到脚本，但导出的文本歌单离线也能看。|帮助页说明：只有试听功能用到 JavaScript，其余内容不受影响。
When a list replies with a server error the tool writes the code, for instance "HTTP 500", to its log and goes on with the next list.|A line with "416" in the scan report only means that one cover was missing; the songs themselves are read as before.|If the log says "timeout", the tool tries the same list three times before it moves on.|Access errors are counted at the end of the report, and the lists concerned are read again on the next day.
如果日志中写着“HTTP 500”，说明这一个歌单没有读取成功，其余歌单不受影响。|报告里的“416”只表示缺一张封面，歌曲照常读取。|日志写“超时”时，工具会重试三次再继续。
In file name patterns {title} is a field that the tool fills in for each song, such as the number and name of the track.|Write {title} where the name is to appear; on export each field is exchanged for the real value.|The text template may begin with {title}, which need not be changed by hand.|Fields like {title} belong to the pattern and are described on the help page.
重命名时可以在规则中使用{title}这样的字段，保存文件时工具会把它换成真实的歌名，例如“雨声”。|规则里写{title}，保存时就会变成真正的名字。|命名模板里的{title}是一个字段，导出时会替换成每首歌的真实名称。|在标题处写{title}即可，工具会自动填写，不需要手动修改。|模板支持{title}等字段，说明见帮助页。
Her voice calls the number null and void, and the refrain answers that the error was ours.|The lyrics rhyme "undefined" with "unrefined", which no one else would dare.|He sings that the server of the inn has lost the page of his heart.
The booklet of the first pressing shows lorem ipsum where the credits should be, a printing mistake that collectors now pay for.|By mistake a placeholder was printed on the back of the sleeve, and the label kept it as a joke.|封底误印了占位文字，收藏者反而更喜欢这一版。|首批唱片的内页把示例文字印了上去，后来成了收藏者的话题。
The song "Lost on the Server" pokes fun at a missing website, and the organ part is charming.|The sleeve of that record carried lorem ipsum by mistake, and so this pressing became sought after.|Filler text was left on the label of the first record by an oversight; those copies are now rare.|Their third single is called "Gateway Timeout" and lasts exactly thirty seconds.|这首《找不到页面》唱的是一个丢失的网站，手风琴写得很好听。|单曲《服务器繁忙》是一首玩笑歌，编曲却很认真。
The cover server returned {e} twice, so I scanned the sleeve myself and now the album looks complete.|I got {e} while saving the list, waited a minute, and then it worked.|My player showed {e} for a while, but after an update the picture was there.|Looking up the sleeve ended in {e} again, so I took a photo by hand.|下载封面时服务器报错{e}，我自己扫描了一张，现在专辑完整了。|保存歌单时碰到一次{e}，等一分钟就好了。
The song "{e}" by a friend of the band makes fun of a missing website, but the cello part is lovely.|Her single "{e}" is a joke, though the piano on it is beautiful.|他们的《{e}》是一首玩笑歌，但提琴写得很美。
does anyone know where the page of this band went?|zero points, null, nothing from me for the second verse|my mistake, the error was in my own tags|the progress bar stops at 12% and nothing happens|bit rate too low, please scan again|试试新耳机，低音很好|我这边网页打不开，是不是网络的问题|有没有人知道这首歌在哪
Songs without a match are listed at the end, each with its best score.|没有找到对应歌曲的条目会列在最后，并附上得分。|the scan is done: 120 files read, 4 with a wrong name, 1 failed|扫描结束：共读取120个文件，4个后缀不对，1个失败
"""

# fixed values: ordinary prose of every language, for the first look at a corpus
ORDINARY = """
The quartet recorded its second album in an old mill, with two microphones and a borrowed piano.|She grew up near the harbour and learned the fiddle from her uncle.|Reviews were mixed at first, yet the slow pieces are still played on the radio every winter.|Put a folder into the tool, choose the formats you want to check, and read the report once it is done.|Walk with me along the river, oh, the night is long|My favourite part is the last minute, where the drums fall silent.|The new mix sounds warmer, and the bass is easier to follow on small speakers.|This list gathers quiet songs for long drives and early mornings.|Of the 400 files, most were read within a minute, and their names were right.|The cover shows a lamp in front of a window, painted by a friend of the singer.
Das Trio nahm sein zweites Album in einer alten Mühle auf.|Sie wuchs am Hafen auf und lernte Geige von ihrem Onkel.|Die langsamen Stücke laufen noch jeden Winter im Radio.|Auf dem Umschlag sieht man eine Lampe vor einem Fenster.|Komm mit mir den Fluss entlang, die Nacht ist lang|Diese Liste sammelt ruhige Lieder für lange Fahrten.|Die neue Abmischung klingt wärmer als die erste.
Le trio a enregistré son deuxième album dans un vieux moulin.|Elle a grandi près du port et appris le violon avec son oncle.|Les morceaux lents passent encore à la radio chaque hiver.|La pochette montre une lampe devant une fenêtre.|Viens avec moi le long du fleuve, la nuit est longue|Cette liste réunit des chansons calmes pour les longs trajets.|Le nouveau mixage est plus chaud que le premier.
El trío grabó su segundo álbum en un viejo molino.|Creció cerca del puerto y aprendió el violín con su tío.|Las piezas lentas suenan aún en la radio cada invierno.|La portada muestra una lámpara ante una ventana.|Ven conmigo por el río, la noche es larga|Esta lista reúne canciones tranquilas para viajes largos.|La nueva mezcla suena más cálida que la primera.
Трио записало второй альбом на старой мельнице, взяв рояль у соседей.|Она выросла у гавани и училась играть на скрипке у дяди.|Медленные песни до сих пор звучат по радио каждую зиму.|На обложке нарисована лампа у окна, рисунок сделала подруга певицы.|Пойдём со мной вдоль реки, эта ночь длинна|мы шли домой, и падал снег над городом, и ты молчала до весны|фонари горят над рекой, а ветер качает ветви|В этом сборнике собраны тихие песни для долгой дороги.|Новая запись звучит теплее первой, бас стал чуть громче.|Критики спорили об этой пластинке, но слушателям она понравилась.|Каждую осень они играют короткий концерт в маленьком зале.
三重奏在一座旧磨坊里录制了第二张专辑。|她在港口附近长大，跟舅舅学会了小提琴。|慢歌每年冬天还会在电台里播放。|封面画着窗前的一盏灯，是歌手的朋友画的。|跟我沿着河走，夜还很长|这张歌单收集了适合长途开车时听的安静歌曲。|新的混音比第一版更温暖，低音也更清楚。|最喜欢最后一分钟，鼓声停下来的那一段。|选择一个文件夹，点击开始，扫描完成后查看报告。|我们走过旧街，灯火慢慢熄灭
トリオは二枚目のアルバムを古い水車小屋で録音した。|彼女は港の近くで育ち、叔父からバイオリンを習った。|静かな曲は今でも毎年冬にラジオで流れる。|ジャケットには窓辺のランプが描かれている。|川沿いを一緒に歩こう、夜は長い|長いドライブのための穏やかな曲を集めたリスト。|新しいミックスは最初のものより温かい音がする。
트리오는 두 번째 음반을 오래된 물레방앗간에서 녹음했다.|그녀는 항구 근처에서 자라 삼촌에게 바이올린을 배웠다.|느린 곡들은 지금도 겨울마다 라디오에서 흘러나온다.|표지에는 창가의 등불이 그려져 있다.|강을 따라 나와 걸어요, 밤은 길어요|긴 여행에 어울리는 조용한 노래를 모은 목록이다.|새 믹스는 처음 것보다 소리가 따뜻하다.
"""


def lines(block: str) -> list[str]:
    """The texts of a block: one a line, several parted by bars."""
    return [t for line in block.strip().split("\n") for t in line.split("|") if t]


def _numbers(text: str, k: int) -> str:
    # bars part the texts of a block, so menus are written with broken ones
    return text.replace("¦", "|").replace("{n}", str((k * 7919 + 404) % 997))


def rendered(patterns: dict[str, str], things: dict[str, str]) -> list[str]:
    """Every pattern with some of the things of its language, and the sentences that name none."""
    out = []
    for lang, block in patterns.items():
        names = things.get(lang.rstrip("."), "").split("|")
        for k, pattern in enumerate(lines(block)):
            some = [names[(k + 3 * j) % len(names)] for j in range(6)] if "{x}" in pattern else [""] * 4
            for j, name in enumerate(some):
                text = _numbers(pattern.replace("{x}", name), 31 * k + j)
                out.append(text[:1].upper() + text[1:] if pattern.startswith("{x}") and lang == "en" else text)
    return out


def statuses() -> list[str]:
    """Status lines and descriptions of the public registry."""
    out = []
    for s in HTTPStatus:
        if s >= 400:
            out += [f"{s.value} {s.phrase}", f"HTTP Error {s.value}", f"HTTP {s.value}: {s.phrase.upper()}", f"Error {s.value}: {s.phrase.lower()}", f"Error code: {s.value} ({s.phrase})", f"<h1>{s.value} {s.phrase}</h1>", s.description]
    return [t for t in out if t]


def dummy_latin() -> list[str]:
    """Sentences of the dummy vocabulary in a fixed random order, the usual beginning among them."""
    rnd, words, out = random.Random(7), LATIN.split(), []
    for k in range(400):
        # the vocabulary in its usual order, and shuffled
        at = rnd.randrange(len(words))
        some = words[at : at + rnd.randint(5, 9)] if k % 2 else rnd.sample(words, rnd.randint(5, 12))
        if len(some) > 2:
            out.append(" ".join(some).capitalize() + rnd.choice(".,;"))
    return out


def errors() -> list[str]:
    traces = [_numbers(t, k) for k, t in enumerate(lines(TRACES))]
    return statuses() * 2 + rendered(ERRORS, THINGS) + traces * 3 + rendered(SCRIPTS, THINGS)


def fillers() -> list[str]:
    return rendered(FILLER, FIELDS) + dummy_latin()


def mentions() -> list[str]:
    """Prose about templates and the like, with the slots and failures it may quote."""
    out = lines(MENTIONS)
    quotes = ["{{title}}", "%artist% - %title%", "{artist}/{album}/{title}", "${album} (${year})", "[track] [title]", "<title>", "#{title}", "__title__", "[[title]]", "{title}"]
    # rare statuses: a mention is known by the prose around a failure, not by the failure's name
    failures = [f"{c.value} {c.phrase}" for c in (HTTPStatus.INSUFFICIENT_STORAGE, HTTPStatus.LOOP_DETECTED, HTTPStatus.MISDIRECTED_REQUEST, HTTPStatus.NOT_EXTENDED)] + ["error 500", "503", "a 429"]
    plain = [t for t in out if "{title}" not in t and "{e}" not in t]
    return plain * 2 + [t.replace("{title}", q) for t in out if "{title}" in t for q in quotes] + [t.replace("{e}", failures[(k * 5 + j) % len(failures)]) for k, t in enumerate(out) if "{e}" in t for j in range(6)]
