"""The evidence model of problem 3: whether a sentence is a message that stands in place of content.

A multinomial logistic regression over words, word pairs and word beginnings, trained in numpy. Its positive sentences
are made by a small grammar (parts of messages in nine languages, put together in every way), its negative ones are
sentences of the corpus itself (a bounded sample) and sentences that only speak of such messages.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import regex
import xxhash

NOTHING, ERROR, HELP, SCRIPT, FILLER = range(5)
#: Places that features are hashed to, and passes over the training sentences.
PLACES, PASSES = 1 << 15, 8
#: Made sentences of one line of the grammar that are trained on, at most; the lowest hashes are taken.
MADE = 160
#: A sentence is a message at this probability, and of a kind at that, if at least such a part of its words is known from messages.
SURE, LIKELY, KNOWN_WORDS = 0.8, 0.5, 0.6

_WORD = regex.compile(r"[\p{Han}\p{Katakana}]+|\p{Hiragana}+|[\p{L}\p{M}\p{N}]+(?:['’][\p{L}]+)?")
_CODE = regex.compile(r"\b[45]\d\d\b")

#: Parts of messages: alternatives are divided by bars, parts by blank lines' worth of a slash. Fixed values.
_ERROR_PARTS = """
the page|this page|that page|the requested page|the page you requested|the page you are looking for|the page you wanted|sorry, this page|oops, that page|hmm, this page|your page / could not be found|can't be found|cannot be found|was not found|wasn't found|isn't here|isn't here any more|is not here anymore|does not exist|doesn't exist|no longer exists|has been removed|was removed|has been deleted|has moved|has gone|is gone|is missing|has gone missing|got lost|has wandered off|has expired|is no longer available|is not available|isn't available|is currently unavailable|failed to load|couldn't be loaded|could not be displayed|can't be shown|seems to be broken
the link|this link|the link you followed|that address|this address|the url|the document|this article|the file|the resource|this content|the item|this post|this listing|the image / is broken|may be broken|has expired|is dead|leads nowhere|does not exist|doesn't exist|is not valid|is invalid|was not found|could not be found|can't be found|has been removed|was deleted|is no longer available|is unavailable|is gone|is missing|cannot be opened|could not be loaded
sorry, we|we|we're sorry, we|sorry but we|unfortunately we / can't find|couldn't find|could not find|cannot find|can't seem to find|were unable to find|are unable to load|couldn't load|can't open|could not display|have lost / the page|this page|that page|the page you wanted|the page you're looking for|what you were looking for|your page|that file|the content|the requested document|anything here
nothing|there is nothing|there's nothing|nothing was found|nothing to see|no page|no such page|no content|no results / here|at this address|at this url|to see here|found|exists here|lives here|matched|to show|to display
the server|our server|the site|this site|this website|the service|our service|the application|this app|the system|the gateway|the backend|the host|the database / is down|is currently down|is unavailable|is temporarily unavailable|is not responding|isn't responding|did not respond|took too long to respond|did not answer|is overloaded|is busy|is offline|is under maintenance|is down for maintenance|is being repaired|is having trouble|has run into a problem|encountered an error|ran into an error|returned an error|has crashed|stopped working|is over capacity|timed out
something|something has|things|it looks like something|well, something|whoops, something / went wrong|has gone wrong|went wrong here|went wrong on our side|went wrong on our end|broke|is broken|failed|unexpected happened|bad happened
an error|an unexpected error|an internal error|a server error|an unknown error|a fatal error|a technical error|an unhandled exception|a problem|a technical problem / occurred|has occurred|happened|was encountered|prevented this page from loading|stopped the request|prevented us from completing your request
access|your access|access to this page|access to this resource|your request|the request|the connection|permission|entry / is denied|was denied|has been denied|denied|forbidden|is forbidden|is not allowed|was refused|was blocked|has been blocked|was rejected|is restricted|has timed out|timed out|could not be completed|could not be processed|failed|was reset
you|sorry, you|it seems you / do not have permission to view this page|don't have permission to view this|are not allowed to see this page|are not authorised to view this page|don't have access to this page|need permission to see this|have been blocked|have sent too many requests|are sending requests too fast|have reached the limit|seem to be lost|have lost your way|have been logged out|have been signed out
your session|the session|this session|your login|your token / has expired|expired|timed out|has timed out|has ended|is no longer valid|is invalid
page not found|not found|file not found|error|server error|internal server error|forbidden|unauthorized|bad gateway|bad request|gateway timeout|service unavailable|temporarily unavailable|too many requests|rate limit exceeded|request timeout|connection refused|connection timed out|access denied|permission denied|out of service|down for maintenance|scheduled maintenance|unexpected error|fatal error|unhandled exception|page unavailable|content unavailable|dead link|broken link / |.|!|here|404|500|503|403|502
die seite|diese seite|die angeforderte seite|die gesuchte seite|der artikel|die datei|das dokument|der inhalt|dieser link|die adresse / wurde nicht gefunden|konnte nicht gefunden werden|wurde gelöscht|wurde entfernt|existiert nicht|existiert nicht mehr|gibt es nicht|gibt es nicht mehr|ist nicht verfügbar|ist nicht mehr verfügbar|ist nicht erreichbar|konnte nicht geladen werden|ist leider verschwunden|ist abgelaufen|fehlt
der server|unser server|der dienst|die website|das system|die anwendung|die datenbank / ist nicht erreichbar|ist derzeit nicht erreichbar|ist vorübergehend nicht verfügbar|antwortet nicht|ist überlastet|ist ausgefallen|wird gerade gewartet|hat einen fehler gemeldet|hat zu lange gebraucht
zugriff|der zugriff|ihre anfrage|die anfrage|die verbindung|ihre sitzung|es ist|leider ist / verweigert|wurde verweigert|wurde blockiert|wurde abgelehnt|ist nicht erlaubt|ist fehlgeschlagen|ist abgelaufen|wurde beendet|ein fehler aufgetreten|ein unerwarteter fehler aufgetreten|etwas schiefgelaufen
seite nicht gefunden|nicht gefunden|zugriff verweigert|interner serverfehler|zu viele anfragen|wartungsarbeiten|fehler|ein fehler ist aufgetreten|hier gibt es nichts|wir konnten die seite nicht finden / |.|!|404|500
la page|cette page|la page demandée|la page que vous cherchez|le document|cet article|le fichier|ce lien|ce contenu|l'adresse / est introuvable|n'existe pas|n'existe plus|n'a pas été trouvée|n'a pas pu être trouvé|a été supprimée|a été déplacé|n'est plus disponible|n'est pas disponible|est indisponible|a disparu|a expiré|n'a pas pu être chargée|ne répond pas
le serveur|le service|le site|ce site|l'application|la base de données|le système / est indisponible|est temporairement indisponible|est momentanément indisponible|ne répond pas|est surchargé|est en panne|est en maintenance|a rencontré une erreur|a mis trop de temps à répondre
l'accès|votre accès|votre requête|la requête|la connexion|votre session|une erreur|un problème|désolé, une erreur / est refusé|a été refusé|est interdit|a été bloquée|a été rejetée|a échoué|a expiré|est survenue|s'est produite|inattendue est survenue|technique est survenu
page introuvable|page non trouvée|accès refusé|accès interdit|erreur interne du serveur|trop de requêtes|site en maintenance|erreur|oups, rien ici|nous n'avons pas trouvé cette page / |.|!|404|500
страница|эта страница|запрошенная страница|страница, которую вы ищете|статья|этот материал|документ|файл|запись|ссылка / не найдена|не найден|не существует|больше не существует|удалена|была удалена|перемещена|недоступна|недоступен|временно недоступна|куда-то исчезла|пропала|потерялась|устарела|не загрузилась|не открывается
сервер|наш сервер|сервис|сайт|приложение|система|база данных / недоступен|временно недоступен|не отвечает|перегружен|не работает|на обслуживании|сообщил об ошибке|слишком долго не отвечал|закрыт на ремонт
доступ|ваш доступ|запрос|ваш запрос|соединение|сессия|ваша сессия|произошла|возникла / запрещён|ограничен|закрыт|отклонён|заблокирован|прервано|истекла|завершена|ошибка|непредвиденная ошибка|внутренняя ошибка|не выполнен
страница не найдена|ничего не найдено|доступ запрещён|ошибка сервера|внутренняя ошибка сервера|слишком много запросов|технические работы|что-то пошло не так|что-то сломалось|здесь ничего нет|мы не нашли эту страницу / |.|!|404|500
сторінка|ця сторінка|сторінку|стаття|цей матеріал|документ|файл|посилання / не знайдена|не знайдено|не існує|більше не існує|видалено|була видалена|недоступна|недоступний|тимчасово недоступна|кудись зникла|застаріло|не завантажилась
сервер|сервіс|сайт|система|доступ|запит|сеанс|сталася|виникла / недоступний|тимчасово недоступний|не відповідає|перевантажений|не працює|заборонено|обмежено|відхилено|заблоковано|завершився|помилка|непередбачена помилка
сторінку не знайдено|нічого не знайдено|доступ заборонено|помилка сервера|забагато запитів|технічні роботи|щось пішло не так|тут нічого немає / |.|!|404|500
la página|esta página|la página solicitada|la página que buscas|el artículo|el archivo|este enlace|este contenido|el documento / no se encuentra|no se ha encontrado|no fue encontrada|no existe|ya no existe|ha sido eliminada|fue borrado|no está disponible|ya no está disponible|ha caducado|se ha perdido|no se pudo cargar|se ha movido
el servidor|el servicio|el sitio|este sitio|la aplicación|el sistema / no está disponible|no responde|está caído|está sobrecargado|está en mantenimiento|ha devuelto un error|tardó demasiado en responder
el acceso|su acceso|su solicitud|la solicitud|la conexión|su sesión|se ha producido|ha ocurrido / está denegado|ha sido denegado|está prohibido|fue bloqueada|fue rechazada|ha fallado|ha caducado|ha expirado|un error|un error inesperado|un problema
página no encontrada|no encontrado|acceso denegado|error interno del servidor|demasiadas solicitudes|en mantenimiento|algo salió mal|algo ha fallado|aquí no hay nada|no encontramos esta página / |.|!|404|500
a página|esta página|a página solicitada|a página que procura|o artigo|o ficheiro|o arquivo|este link|este conteúdo|o documento / não foi encontrada|não foi encontrado|não existe|já não existe|não existe mais|foi removida|foi eliminado|foi apagada|não está disponível|está indisponível|expirou|desapareceu|não pôde ser carregada|mudou de lugar
o servidor|o serviço|o site|este site|a aplicação|o sistema / não está disponível|está indisponível|não responde|está em baixo|está sobrecarregado|está em manutenção|devolveu um erro|demorou demasiado a responder
o acesso|o seu acesso|o seu pedido|a solicitação|a ligação|a sua sessão|ocorreu|houve / foi negado|foi recusado|é proibido|foi bloqueado|foi rejeitada|falhou|expirou|terminou|um erro|um erro inesperado|um problema
página não encontrada|não encontrado|acesso negado|erro interno do servidor|muitas solicitações|em manutenção|algo deu errado|algo correu mal|não há nada aqui|não encontramos esta página / |.|!|404|500
strona|ta strona|żądana strona|strona, której szukasz|artykuł|plik|ten link|dokument|ta treść / nie została znaleziona|nie istnieje|już nie istnieje|została usunięta|został usunięty|jest niedostępna|jest chwilowo niedostępny|wygasła|zniknęła|nie mogła zostać załadowana|została przeniesiona
serwer|nasz serwer|usługa|serwis|aplikacja|system|dostęp|żądanie|sesja|wystąpił / jest niedostępny|nie odpowiada|jest przeciążony|nie działa|jest w trakcie konserwacji|zabroniony|został odrzucony|zostało zablokowane|wygasła|błąd|nieoczekiwany błąd|problem
nie znaleziono strony|strony nie znaleziono|odmowa dostępu|błąd serwera|wewnętrzny błąd serwera|zbyt wiele żądań|przerwa techniczna|coś poszło nie tak|nic tu nie ma|nie możemy znaleźć tej strony / |.|!|404|500
ページが|お探しのページは|このページは|記事が|ファイルが|リンクが|コンテンツは|サーバーが|サービスは|サイトは / 見つかりません|見つかりませんでした|存在しません|削除されました|移動しました|利用できません|表示できません|応答しません|停止しています|混み合っています|メンテナンス中です|期限切れです|エラーが発生しました|アクセスできません
アクセスが拒否されました|エラーが発生しました|内部サーバーエラー|リクエストが多すぎます|セッションの有効期限が切れました|問題が発生しました|ただいまメンテナンス中です|何も見つかりませんでした / |。
"""
_HELP_PARTS = """
please|you can|you may|kindly|just / try again|try again later|try again in a few minutes|reload the page|refresh the page|check the address|check the url|check the spelling|go back|go back to the home page|return to the start page|use the search|use the search box|contact support|contact us|contact the administrator|come back later|wait a moment|log in again|sign in again
go back|back|return|take me back|go / home|to the home page|to the homepage|to the start page|to safety|and try again
our team|our engineers|we|the administrator|someone / has been told|have been notified|has been notified|are working on it|are on it|are fixing it|will be back soon|will be back shortly|apologise for the inconvenience|are sorry for the trouble
bitte|sie können / versuchen sie es später erneut|versuchen sie es später noch einmal|laden sie die seite neu|prüfen sie die adresse|gehen sie zurück|nutzen sie die suche|melden sie sich erneut an|zur startseite zurückkehren
veuillez|vous pouvez|merci de / réessayer plus tard|réessayer dans quelques minutes|recharger la page|vérifier l'adresse|retourner à l'accueil|utiliser la recherche|vous reconnecter
пожалуйста,|вы можете|просто / попробуйте позже|повторите попытку позже|обновите страницу|проверьте адрес|вернитесь на главную|воспользуйтесь поиском|войдите снова|зайдите позже
будь ласка,|ви можете / спробуйте пізніше|повторіть спробу пізніше|оновіть сторінку|перевірте адресу|поверніться на головну|скористайтеся пошуком
por favor,|puede|puedes / inténtelo de nuevo más tarde|inténtalo más tarde|vuelva a cargar la página|compruebe la dirección|volver a la página de inicio|use el buscador
por favor,|pode / tente novamente mais tarde|tente mais tarde|recarregue a página|verifique o endereço|voltar à página inicial|use a pesquisa
proszę|możesz / spróbować ponownie później|spróbuj ponownie później|odświeżyć stronę|sprawdzić adres|wrócić na stronę główną|skorzystać z wyszukiwarki
しばらくしてから|後ほど|もう一度 / お試しください|アクセスしてください|やり直してください
"""
_SCRIPT_PARTS = """
please|you need to|you must|you'll need to|you have to|kindly|to view this page, please|to continue, please|to use this site, / enable javascript|turn on javascript|switch on javascript|activate javascript|allow javascript|enable scripts|allow scripts|turn javascript on|have javascript enabled|have javascript switched on to read this|enable javascript in your browser|enable javascript to run this app
javascript|scripts|scripting|client-side scripting / is required|is needed|is disabled|is turned off|is switched off|is not enabled|must be enabled|must be turned on|is disabled in your browser|is required to view this page|is needed to show this page|is off
this page|this site|this app|this website|this application|our site|the page / requires javascript|needs javascript|won't work without javascript|does not work without javascript|doesn't work without scripts|works only with javascript enabled|relies on javascript|can't be shown without javascript
your browser|it seems your browser|it looks like your browser / does not support javascript|doesn't support javascript|has javascript disabled|has javascript turned off|has scripts disabled|blocks javascript|is blocking scripts
bitte|sie müssen|um diese seite zu nutzen, / aktivieren sie javascript|schalten sie javascript ein|javascript aktivieren|erlauben sie javascript|skripte erlauben|javascript muss aktiviert sein
javascript|diese seite|diese website|ihr browser / muss aktiviert sein|ist deaktiviert|ist ausgeschaltet|ist erforderlich|wird benötigt|benötigt javascript|braucht javascript|funktioniert nicht ohne javascript|blockiert javascript|unterstützt kein javascript
veuillez|merci d'|vous devez / activer javascript|activer les scripts|autoriser javascript|activer javascript dans votre navigateur
javascript|cette page|ce site|votre navigateur / est désactivé|est requis|est nécessaire|doit être activé|nécessite javascript|a besoin de javascript|ne fonctionne pas sans javascript|bloque javascript
пожалуйста,|необходимо|вам нужно|для работы сайта / включите javascript|включить javascript|разрешите скрипты|включите поддержку javascript|нужен javascript|требуется javascript
javascript|скрипты|ваш браузер|эта страница / отключён|выключен|отключены|не поддерживает javascript|не работает без javascript|требует javascript
будь ласка,|потрібно / увімкніть javascript|увімкнути javascript|дозвольте скрипти|потрібен javascript|javascript вимкнено
por favor,|debe|necesita / activar javascript|active javascript|habilite javascript|habilitar javascript|permita los scripts|javascript está desactivado|esta página necesita javascript
por favor,|deve|é necessário / ativar javascript|ative o javascript|habilite o javascript|permita os scripts|o javascript está desativado|esta página precisa de javascript
proszę|musisz|aby zobaczyć stronę, / włączyć javascript|włącz javascript|włącz obsługę javascript|zezwól na skrypty|javascript jest wyłączony|ta strona wymaga javascriptu
javascriptを|このページは / 有効にしてください|javascriptが必要です|javascriptが無効です|javascriptを有効にしてください
"""
_FILLER_PARTS = """
your|sample|placeholder|dummy|example|demo|insert|add|write|type / text here|text goes here|heading here|headline goes here|title here|content here|content goes here|copy goes here|paragraph goes here|description here|caption goes here|your text here|your content here|a short description here
this is|here is|this is just|this is only / sample text|placeholder text|dummy text|example content|a placeholder|a text block|a sample paragraph|a test page|demo content|some sample copy
replace this|edit this|click to edit this|change this|delete this / text|paragraph|placeholder|sample text|heading|with your own text|before you publish|before launch
coming|page|content|site / coming soon|under construction|to be added|to be announced|will be added here|goes here
hier|platzhalter|beispieltext / steht ihr text|steht der text|kommt ihr text hin|folgt der inhalt|für den text|bitte ersetzen
votre texte|exemple de texte|insérez votre texte|texte d'exemple|contenu / ici|à remplacer|à venir
ваш текст|здесь будет текст|пример текста|вставьте текст|заголовок|текст-заполнитель / здесь|сюда|появится позже
su texto|tu texto|texto de ejemplo|escriba su texto|seu texto|texto de exemplo / aquí|aqui|va aquí|fica aqui
ваш текст|приклад тексту|twój tekst|przykładowy tekst|ここにテキスト / тут|tutaj|を入力
"""
#: Sentences that only speak of such things. Fixed values.
_ABOUT = """
this guide|the article|chapter two|our post|the handbook|the author|my talk / explains how to design|describes how we improved|shows how to test|is about|compares / a friendly 404 page|an error page|a page that was not found|the javascript banner|the message that scripts are required|placeholder text in a design|the old maintenance page|status codes such as 404 and 500
the test|the crawler|the monitor|our script|the team|the operator|the reader|the proxy / counts|records|reports|measured|logged|found|fixed / every page that could not be found|the number of errors|pages with javascript disabled|a server error last week|twelve broken links|an error in the budget|the access log|all requests that timed out
the library|the harbour|the road|the museum|the shop|the ferry|the office|the course|the bridge|the market / is closed on monday|is open until nine|was moved to the new building|has been removed from the map|is not available in winter|was not found in the old records|is under construction until may|can be found next to the station|needs a new roof|was closed after the storm
the page|this page|your page|the article|this post|the document|the file|the link|your order|your account|our team|the list|the text|the title|a heading|the content|the description|the sample|an example|short page|page two|two words|the first line / |is short|is long|has two columns|of the harbour|was written in may|is about boats|shows the prices|for new members|and its parts|of the week
the server|our server|the service|the site|this website|our system|the application|your browser|the database|the request|the connection|your session|access|an error|a problem|something / |stores the files|serves four offices|is fast|was bought last year|runs in the cellar|of the library|with two disks|and the network|counts the visits
your|our|new|more|add|type|write|insert / own words|order|basket|ideas for the garden|recipes|milk and sugar|content every day|pages for children|photos of the trip|a new member|a letter to the editor
seite|diese seite|der server|der dienst|ihr browser|la page|le serveur|le service|la página|el servidor|o servidor|a página|strona|serwer|страница|сервер|сторінка|ページ|サーバー / |des vereins|im keller|de la ville|du club|de la ciudad|da cidade|miasta|klubu|города|клуба|міста|の一覧|の写真
the screen said|the sign read|she wrote|he saw|they told us|once we read|it said / page not found|access denied|that the server was down|that something went wrong|that the file was gone|please try again / , and nobody knew why|, so everyone went home|, which made us laugh|, then closed the ticket|, because the shop had moved|, and the story ended there
please|you can|you may|customers can|readers / bring your own cup|send your questions to the editor|find the list in the annex|check the weather before you leave|use the side entrance|return the books by friday|try the soup|go home early today
"""


def _made(parts: str) -> list[str]:
    """Every combination of the parts of each line of a grammar; of lines with many, those of the lowest hashes."""
    out: list[str] = []
    for line in parts.strip().splitlines():
        every = [" ".join(x for x in p if x).replace("' ", "'") for p in product(*([y.strip() for y in x.split("|")] for x in line.split(" / ")))]
        out += sorted(set(every), key=xxhash.xxh64_intdigest)[:MADE]
    return out


def words_of(sentence: str) -> list[str]:
    found = _WORD.findall(sentence.lower().replace("’", "'"))
    out: list[str] = []
    for word in found:  # scripts without spaces: pairs of characters
        out += [word] if word[0] < "　" or len(word) < 2 else [word[k : k + 2] for k in range(len(word) - 1)]
    return out


#: Marks around words, for a cheap look at the words of a sentence.
_MARKS = ".,;:!?\"'()[]{}*_`~#+-–—…“”„«»‘’|/"


def plain_words(text: str) -> list[str]:
    """The words of a text in lower case as they stand between white space, without the marks around them."""
    return [w.strip(_MARKS) for w in text.lower().split()]


def features(sentence: str) -> np.ndarray:
    """Places of the words, their beginnings, the pairs of neighbours and the status code of a sentence, each once."""
    words = words_of(sentence)
    names = [f"w{w}" for w in words] + [f"b{w[:5]}" for w in words] + [f"p{a[:6]} {b[:6]}" for a, b in zip(["^", *words], [*words, "$"])] + [f"s{a[:5]} {b[:5]}" for a, b in zip(words, words[2:])]
    if _CODE.search(sentence):
        names.append("code")
    names.append(f"n{min(len(words), 30) // 3}")
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(x) % PLACES for x in names), dtype=np.int64))


@dataclass
class Messages:
    """Weights of the five kinds, and the words that messages have."""

    weights: np.ndarray
    bias: np.ndarray
    known: frozenset = field(default_factory=frozenset)

    def kind(self, sentence: str) -> int:
        """The kind of a sentence; ``NOTHING`` unless the model is sure."""
        cheap = plain_words(sentence)
        if cheap and max(cheap) < "　" and 2 * sum(w[:5] in self.known for w in cheap) < len(cheap):
            return NOTHING
        words = words_of(sentence)
        if len(words) < 2 or sum(w[:5] in self.known for w in words) < KNOWN_WORDS * len(words):
            return NOTHING
        at = features(sentence)
        scores = self.bias + self.weights[at].sum(axis=0) / np.sqrt(len(at))
        scores = np.exp(scores - scores.max())
        scores /= scores.sum()
        # error and help together may be sure where each alone is not
        kind = int(np.argmax(scores[1:]) + 1)
        return kind if 1 - scores[NOTHING] >= SURE and scores[kind] >= LIKELY else NOTHING


def train_messages(others: Iterable[str]) -> Messages:
    """The model of messages against the sentences ``others`` of the corpus; the same for the same sentences."""
    rows = [(s, k) for k, parts in ((ERROR, _ERROR_PARTS), (HELP, _HELP_PARTS), (SCRIPT, _SCRIPT_PARTS), (FILLER, _FILLER_PARTS)) for s in _made(parts)]
    known = frozenset(w[:5] for s, _ in rows for w in words_of(s))
    # content that shares no words with messages is told apart by those words alone
    near = [s for s in dict.fromkeys(others) if sum(w[:5] in known for w in words_of(s)) >= 0.4 * max(1, len(words_of(s)))]
    rows += [(s, NOTHING) for s in [*_made(_ABOUT), *near]]
    labels = np.array([k for _, k in rows])
    places = [features(s) for s, _ in rows]
    weights, bias = np.zeros((PLACES, 5)), np.zeros(5)
    squares = np.full((PLACES, 5), 1e-3)
    balance = np.array([len(rows) / (5 * max(1, int((labels == k).sum()))) for k in range(5)]).clip(0.2, 3)
    balance[NOTHING] = 1.5
    random = np.random.default_rng(7)
    for step in range(PASSES):
        for i in random.permutation(len(rows)):
            at, scale = places[i], 1 / np.sqrt(len(places[i]))
            scores = bias + weights[at].sum(axis=0) * scale
            scores = np.exp(scores - scores.max())
            wrong = scores / scores.sum()
            wrong[labels[i]] -= 1
            wrong *= balance[labels[i]]
            slope = wrong * scale + 1e-4 * weights[at]
            squares[at] += slope * slope
            weights[at] -= 0.3 * slope / np.sqrt(squares[at])
            bias -= 0.02 * wrong / (1 + step)
    return Messages(weights.astype(np.float32), bias.astype(np.float32), known)
