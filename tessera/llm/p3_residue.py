"""Problem 3: template residue and error-page text.

Each record becomes lines; the normalised lines of a host are counted over all its records, and those that recur are
its boilerplate. What is left of a record is its residual. A record is a case if its readable text or title has a
placeholder nobody filled, or if its residual has filler, an error message or a notice that scripts are needed and
next to no content beside it. A notice that recurs beside the content of a host's records is boilerplate of that host
too, and no evidence. Sentences are told by a trained model (`p3_messages`) and by forms that it can't learn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import if_small
from tessera.llm.p2_site_lines import site_of
from tessera.llm.p3_messages import ERROR, FILLER, HELP, NOTHING, SCRIPT, Messages, plain_words, train_messages
from tessera.session import settle

#: A line is boilerplate of a host if at least so many of its records and such a part of them have it.
RECURRENT_RECORDS, RECURRENT_SHARE = 5, 0.02
#: Words of content up to which evidence stands in place of content.
MOST_CONTENT_WORDS = 40
#: Filler also stands in place of content if it has so many times the words of the content.
FILLER_SHARE = 1.0
#: At most so many records give sentences of the corpus to train the evidence model against, if they have so many words.
TRAINING_RECORDS, TRAINING_WORDS = 1_500, 150
#: Lines remembered by a worker; emptied when full.
REMEMBERED = 200_000

PLAIN, HEADING, LINK, CODE, CHROME = range(5)

#: Ways to write a field that is to be filled in. Fixed values.
_PLACEHOLDER = regex.compile(
    r"\{\{[^{}\n]+\}\}|\[\[[A-Za-z_][\w.]*\]\]|[#$]\{[\w .]+\}|%%[\w .]{2,}%%|<%=?[^%<>\n]+%>|\{%[^%{}\n]+%\}"
    r"|(?<![\w{$#f\"'])\{[A-Za-z_][\w.]+\}(?![\w}])|@@\w[\w.]+@@|(?<![\w_])__[A-Z][A-Z_.]+__(?![\w_])|\*\|\w[\w.: ]+\|\*"
    r"|\[(?:INSERT|YOUR|insert|your|Insert|Your)[ _][\w .]+\]|(?<![\w%])%[A-Z][A-Z_]{2,}%(?![\w%])|\[PLACEHOLDER\]"
    r"|\b(?:[Dd]ear|DEAR|[Hh]ello|HELLO|[Hh]i|HI|[Ww]elcome|WELCOME|[Hh]allo|[Bb]onjour|[Hh]ola|[Oo]lá),? (?:\[[A-Za-z_][\w ]*\](?![(\[:])|\$[A-Za-z_]\w*\b|<[A-Za-z_][\w ]*>)"
)
#: A name in brackets that is no link.
_BRACKETED = re.compile(r"\[[A-Za-z_][\w .]*\](?![(\[:])")


def maybe_placeholder(text: str) -> bool:
    """What every placeholder has and most lines have not, by marks alone."""
    return "{" in text or "%" in text or "@@" in text or "__" in text or "*|" in text or "$" in text or "<" in text or "[[" in text or ("[" in text and _BRACKETED.search(text) is not None)


def has_placeholder(text: str) -> bool:
    """Whether a field that nobody filled stands in a readable text."""
    return maybe_placeholder(text) and _PLACEHOLDER.search(text) is not None


#: Words of typing exercises and of the usual dummy text. Fixed values.
_MASHED = frozenset("foo bar baz qux quux test tests asdf qwer qwerty zxcv xxxx xxx xx blah bla abc lorem ipsum aaa tbd todo hjkl".split())
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat "
    "non proident sunt culpa qui officia deserunt mollit anim id est laborum donec vivamus praesent pellentesque vestibulum curabitur mauris nunc lacus porta mattis felis augue tortor massa "
    "pulvinar sodales viverra faucibus maecenas phasellus integer aenean quisque nullam fusce morbi cras etiam proin suspendisse tincidunt ultrices ultricies vel at ac nec eget turpis".split()
)
_CODE_NUMBER = r"(?:4\d\d|5\d\d)"
#: Whole sentences that a page has instead of content, by language; a name may stand where \S+ stands. Fixed values.
_ERROR_SENTENCES = [
    rf"(?:http )?(?:status )?(?:error|erreur|fehler|erro|ошибка|помилка|błąd|エラー)[ :#]*(?:code )?{_CODE_NUMBER}(?:\W.{{0,60}})?",
    r"\d{1,4} ?[–—|] ?(?:resource unavailable|not found|internal error|forbidden|page not found|service unavailable|bad gateway)",
    rf"{_CODE_NUMBER} ?(?:[–—|:·-] ?)?(?:error|page|not found|forbidden|internal|resource|server|bad|service|gateway|unavailable|too many|access|gone|unauthorized|unauthorised)\b.{{0,50}}",
    r"(?:the |this |that |requested )*(?:page|resource|file|document|article|listing|item|entry|content|address|link|url|site|post|product)(?: you (?:requested|followed|asked for|are looking for|were looking for))? (?:was |is |has |have |can |could |has been |may have |might have |cannot |can't |couldn't |no |longer )*(?:not )?(?:be )?(?:found|gone missing|gone|expired|removed|moved|deleted|unavailable|no longer (?:online|available|exists?|here)|not available|refused|does(?:n't| not) exist|taken down)(?: (?:or|and) \w+)?(?: anymore)?",
    r"(?:sorry,? )?we (?:can't|cannot|couldn't|could not|are unable to) (?:find|locate|show|display|load|open) (?:that|this|the|your) (?:page|file|article|content|resource|listing).{0,30}",
    r"you seem to have lost your way|you (?:seem|appear) to be lost.{0,20}|nothing (?:lives|is|was found|to see) (?:at this address|here|there).{0,20}|there(?: is|'s) nothing (?:here|at this address).{0,20}",
    r"(?:404|page|nothing|not) (?:not )?found|no (?:matching )?(?:route|results?|page|such page|such file)(?: found| matched)?.{0,20}",
    r"(?:access|permission|request|entry|connection)(?: to this (?:page|site|resource|server))? (?:was |is |has been )?(?:denied|refused|forbidden|blocked|rejected|timed out|reset)(?: by \w+(?: \d+)?)?|forbidden|unauthori[sz]ed|you (?:do not|don't) have (?:permission|access|the rights?) to .{3,40}",
    r"(?:sorry,? |oops[,!.]? |whoops[,!.]? |uh oh[,!.]? )?(?:something|that|this|it) (?:went wrong|broke|failed|didn't work|did not work|is broken)(?: on our (?:side|end))?.{0,20}|oops,? \S+(?: \S+)? (?:could not|couldn't|can't|cannot) (?:load|open|find|show) .{2,30}|oops",
    r"an? (?:unexpected|internal|unknown|unhandled|application|server) (?:condition|error|problem|exception)(?: has)? ?(?:stopped the request|occurred|happened|was encountered)?|internal (?:server )?error|bad (?:gateway|request)|gateway time-?out|server error|application error|database error",
    r"(?:the |this )?(?:service|server|site|system|page)(?: is| are)? (?:temporarily |currently )?(?:unavailable|down|offline|overloaded|busy|taking a break|under maintenance|being repaired|out of service).{0,40}|\S+(?: \S+)? is (?:being repaired|down|under maintenance|offline)(?: and will be back .{2,20})?|we are over capacity(?: right now)?|down for maintenance",
    r"too many requests(?: from .{3,30})?|rate limit(?: exceeded)?|(?:your )?session (?:has )?(?:expired|timed out|ended)|upstream (?:did not answer|timed out|failed).{0,40}|resource unavailable",
    r"(?:uncaught|unhandled|fatal) \S+(?: \S+)? in \S+(?: on)? line \d+.{0,20}|(?:uncaught|unhandled|fatal) (?:exception|error)\b.{0,60}|traceback \(most recent call last\):?|at [\w.$<>]+ ?\([^()]{1,60}\)|\w*(?:error|exception): .{0,80}|warning: .{2,60} on line \d+",
    # de
    r"(?:die )?(?:seite|datei|ressource|inhalt|artikel|adresse)(?: wurde| konnte| ist)? nicht (?:gefunden|verfügbar|vorhanden|mehr verfügbar)(?: werden)?|(?:zugriff|zugang|anfrage) (?:wurde )?(?:verweigert|abgelehnt|blockiert|gesperrt)|(?:dienst|server|seite|dieser dienst) (?:ist )?(?:vorübergehend |derzeit |zurzeit )?nicht (?:erreichbar|verfügbar)|zu viele (?:anfragen|zugriffe).{0,20}|interner (?:server)?fehler|(?:ihre )?sitzung (?:ist )?abgelaufen|es ist ein (?:\w+ )?fehler aufgetreten|etwas ist schiefgelaufen|wartungsarbeiten|unerwarteter fehler",
    # fr
    r"(?:cette |la )?page (?:est )?(?:introuvable|inexistante|non trouvée|indisponible)|accès (?:refusé|interdit|bloqué)|(?:le )?service (?:est )?(?:momentanément |temporairement |actuellement )?indisponible|trop de requêtes.{0,20}|erreur interne(?: du serveur)?|(?:votre )?session (?:a )?expirée?|une erreur (?:inattendue )?(?:est survenue|s'est produite)|requête (?:bloquée|refusée).{0,20}|site en maintenance",
    # ru, uk
    r"(?:эта )?(?:страница|страницы|материал|запись|файл|адрес) (?:не найдена?|не найдено|не существует|недоступна?|удалена?|больше не существует)|доступ (?:запрещ[её]н|закрыт|ограничен|отклон[её]н)|(?:сервис|сервер|служба|сайт) (?:временно )?недоступ(?:ен|на)|слишком много запросов.{0,20}|внутренняя ошибка(?: сервера)?|(?:ваша )?сессия (?:истекла|завершена)|произошла (?:\w+ )?ошибка|что-то пошло не так|запрос (?:заблокирован|отклон[её]н).{0,20}|ведутся технические работы",
    r"(?:цю |ця )?(?:сторінк[ау]|сторінки|матеріал|запис|файл) (?:не знайдено|не існує|недоступн[аий]+|видалено)|доступ (?:заборонено|обмежено|закрито)|(?:сервіс|служба|сервер|сайт) (?:тимчасово )?недоступн(?:ий|а)|забагато запитів.{0,20}|занадто багато запитів.{0,20}|внутрішня помилка(?: сервера)?|сеанс (?:завершено|закінчився)|сталася (?:\w+ )?помилка|щось пішло не так",
    # es, pt
    r"(?:la )?página no (?:encontrada|existe|disponible)|no (?:se ha encontrado|se encontró|encontramos) (?:la|esta) página|acceso (?:denegado|prohibido|bloqueado)|(?:el )?servicio (?:temporalmente )?no disponible(?: temporalmente)?|demasiadas (?:solicitudes|peticiones).{0,20}|error interno(?: del servidor)?|(?:su |la )?sesión (?:ha )?(?:expirado|caducado|caducada)|ha ocurrido un error.{0,20}|algo (?:salió|ha ido) mal",
    r"(?:a )?página (?:não (?:foi )?encontrada|inexistente|indisponível)|não (?:encontramos|foi possível encontrar) (?:a|esta|essa) página|acesso (?:negado|proibido|bloqueado|recusado)|(?:o )?serviço (?:temporariamente |momentaneamente )?indisponível(?: no momento)?|(?:muitas|demasiados|demasiadas|excesso de) (?:solicitações|pedidos|requisições).{0,20}|erro interno(?: do servidor)?|(?:a )?(?:sua )?sessão (?:expirou|expirada)|ocorreu um erro.{0,20}|algo (?:deu|correu) (?:errado|mal)",
    # pl, ja
    r"(?:nie znaleziono (?:strony|pliku|zasobu)|strona? (?:nie (?:została )?(?:znaleziona|istnieje)|niedostępna)|strony nie znaleziono)|(?:odmowa dostępu|dostęp (?:zabroniony|zablokowany)|brak dostępu)|usługa (?:jest )?(?:chwilowo |tymczasowo )?niedostępna|zbyt wiele (?:żądań|zapytań).{0,20}|(?:wewnętrzny )?błąd (?:wewnętrzny )?serwera|sesja wygasła|wystąpił (?:\w+ )?błąd|coś poszło nie tak",
    r"(?:お探しの|この|その)?ページ(?:が|は)?(?:見つかりません(?:でした)?|存在しません|ありません)|アクセス(?:が|は)?(?:拒否されました|できません|禁止されています)|(?:サービス|サーバー)(?:は|が)?(?:一時的に|現在)?(?:利用できません|ご利用いただけません|停止しています)|リクエストが多すぎます|(?:内部|サーバー)エラー.{0,10}|セッション(?:の有効期限)?が切れました|エラーが発生しました",
]
_HELP_SENTENCES = [
    r"(?:please )?(?:try|check|use|go|return|contact|reload|refresh|wait|come)\b.{0,20}\b(?:again|later|address|url|search box|start page|home ?page|support|newsroom|desk|team|page|back|code \S+|minutes?)\b.{0,40}|check the address or go back to the start page|use the search box to look for it|contact \S+(?: \S+){0,4} and quote code .{1,20}",
    r"(?:our|the) (?:engineers|team|developers?) (?:have|has) been (?:told|notified|informed)|reference(?: code| id| no\.?)?[ :#]*\w{0,20}|(?:error|request|ray|incident) (?:code|id|no\.?)[ :#]*[\w-]{1,40}|the item may have been moved or deleted|we(?:'re| are) (?:working on it|sorry.{0,30})|please try again.{0,40}|the (?:content|page) (?:was|has been) moved",
    r"bitte versuchen sie es .{3,40}|prüfen sie die adresse .{0,50}|der inhalt wurde (?:verschoben|gelöscht|entfernt).{0,20}|gehen sie zur startseite|vorgangsnummer.{0,20}|unsere technik.{0,40}",
    r"(?:veuillez )?réessayez? .{2,40}|vérifiez l['’]adresse .{0,50}|le contenu a été (?:déplacé|supprimé).{0,20}|nos équipes .{3,40}|référence.{0,20}",
    r"повторите попытку .{2,40}|проверьте адрес .{0,50}|материал (?:удал[её]н|перемещ[её]н|перенес[её]н)(?: или \w+)?|код (?:обращения|ошибки).{0,20}|попробуйте .{3,40}|вернитесь на главную|наши инженеры .{3,40}",
    r"(?:спробуйте|повторіть спробу) .{2,40}|перевірте адресу .{0,50}|матеріал (?:видалено|переміщено|перенесено)(?: або \w+)?|код (?:звернення|помилки).{0,20}",
    r"(?:vuelva a intentarlo|inténtelo|intente|vuelve a intentarlo|inténtalo) .{2,40}|(?:compruebe|compruebe|revise|comprueba|revisa) la dirección .{0,50}|el contenido (?:se ha movido|ha sido (?:movido|eliminado)).{0,20}|referencia.{0,20}",
    r"(?:tente|tenta) (?:novamente|de novo|outra vez) .{0,40}|verifique o endereço .{0,50}|o conteúdo foi (?:movido|removido|apagado).{0,20}|referência.{0,20}",
    r"spróbuj (?:ponownie|jeszcze raz) .{0,40}|sprawdź adres .{0,50}|treść została (?:przeniesiona|usunięta).{0,20}|numer zgłoszenia.{0,20}",
    r".{0,10}(?:後に|もう一度)(?:お試し|試して)(?:ください)?|アドレスを(?:確認|お確かめ).{0,20}",
]
_SCRIPT_WORD = r"(?:java ?script|scripts?|scripting|skripte?|сценари[ий]|скрипты?|скрипти|сценарії|skrypty|skryptów)"
_SCRIPT_SENTENCES = [
    rf"(?:please |you need to |you must |to .{{3,40}},? )?(?:please )?(?:enable|turn on|activate|allow|switch on) {_SCRIPT_WORD}\b.{{0,60}}|{_SCRIPT_WORD} (?:is|are|must be) (?:required|needed|disabled|turned off|switched off|off|not enabled|enabled)\b.{{0,60}}|this (?:page|site|app|application) (?:works best with|requires|needs) {_SCRIPT_WORD}\b.{{0,40}}|your browser (?:has it disabled|does not support {_SCRIPT_WORD}|has {_SCRIPT_WORD} (?:disabled|turned off)).{{0,60}}|loading\W{{0,4}}(?: ?if nothing happens,? .{{3,60}})?|if nothing happens,? .{{3,60}}",
    rf"bitte (?:aktivieren|erlauben) sie {_SCRIPT_WORD}.{{0,50}}|{_SCRIPT_WORD} (?:sind|ist) .{{0,40}}(?:ausgeschaltet|deaktiviert|erforderlich|nötig|abgeschaltet)|(?:diese|für diese) (?:seite|website) (?:benötigt|braucht|erfordert|wird) {_SCRIPT_WORD}.{{0,30}}",
    rf"(?:veuillez |merci d['’])?(?:activer|activez|autoriser|autorisez) (?:le |les )?{_SCRIPT_WORD}.{{0,50}}|(?:les |le )?{_SCRIPT_WORD} (?:sont|est) (?:désactivés?|nécessaires?|requis).{{0,40}}|(?:cette page|ce site) (?:nécessite|requiert|a besoin de) {_SCRIPT_WORD}.{{0,30}}",
    rf"(?:для .{{3,40}} )?(?:пожалуйста,? )?включите (?:их|поддержку )?(?:{_SCRIPT_WORD})?.{{0,40}}|{_SCRIPT_WORD} (?:отключен[аы]?|выключен[аы]?|не поддержива\w+).{{0,40}}|(?:для .{{3,40}} )?(?:нуж[енн]+о?|требуется|необходим[оы]?) {_SCRIPT_WORD}.{{0,30}}|(?:для .{{3,40}} )?увімкніть {_SCRIPT_WORD}.{{0,40}}|{_SCRIPT_WORD} (?:вимкнен[оі]|відключен[оі]).{{0,40}}|(?:для .{{3,40}} )?(?:потрібн[аоіе]+|необхідн[аоіе]+) {_SCRIPT_WORD}.{{0,30}}",
    rf"(?:por favor,? )?(?:activa|active|habilita|habilite|ative|ativa|permita|permite) (?:el |o |los |os )?{_SCRIPT_WORD}.{{0,50}}|(?:tu|su|seu|o seu|o teu) navegador (?:tiene|tem|no admite|não suporta) .{{0,30}}{_SCRIPT_WORD}.{{0,30}}|(?:esta página|este sitio|este site) (?:necesita|requiere|precisa de|requer) {_SCRIPT_WORD}.{{0,30}}|(?:los|os) {_SCRIPT_WORD} (?:están|estão) .{{3,40}}",
    rf"(?:proszę )?(?:włącz|włączyć|zezwól na) (?:obsługę )?{_SCRIPT_WORD}.{{0,50}}|{_SCRIPT_WORD} (?:jest|są) (?:wyłączon\w+|wymagan\w+).{{0,40}}|(?:ta )?strona wymaga {_SCRIPT_WORD}.{{0,30}}|.{{0,20}}javascript(?:を|が)(?:有効|必要|無効).{{0,20}}",
]
_FILLER_SENTENCES = [
    r"(?:your|sample|placeholder|example|demo|dummy) (?:text|content|heading|title|paragraph|copy|caption|headline)(?: (?:goes|comes) here| here)?(?:\W.{0,60}| for .{3,60})?|(?:insert|add|type|write|enter|put) (?:a |an |your )?(?:short )?(?:copy|text|description|story|content|headline|title|caption)\b.{0,50}|this is (?:a|an|some|the) (?:text block|sample|placeholder|example|dummy|test)\b.{0,50}|click (?:here )?(?:edit )?to (?:edit|change) .{1,20}|(?:do not publish|replace before launch|coming soon|under construction|to be (?:written|announced|added))|demo content\W.{0,30}",
    r"hier (?:steht|kommt) (?:ihr|der|ein|dein) (?:text|platzhaltertext|blindtext).{0,30}|(?:beispiel|platzhalter|blind)(?:text|überschrift|titel)\b.{0,40}|(?:votre|exemple de|insérez (?:votre|le)) texte(?: ici)?.{0,30}|(?:ваш|здесь будет|пример|вставьте) текст(?:а)?.{0,30}|(?:ваш|тут буде|приклад) текст(?:у)?.{0,30}|(?:su|tu|seu|o seu) texto (?:aquí|aqui|va aquí).{0,30}|(?:twój|przykładowy|tutaj wpisz) tekst.{0,30}|ここにテキスト.{0,20}",
]


def _any(patterns: list[str]) -> re.Pattern:
    return re.compile("(?:" + "|".join(patterns) + ")", re.I)


_KINDS = [(ERROR, _any(_ERROR_SENTENCES)), (SCRIPT, _any(_SCRIPT_SENTENCES)), (FILLER, _any(_FILLER_SENTENCES)), (HELP, _any(_HELP_SENTENCES))]
_BARE = " \t*_`.!。！\"'“”«»|"
_DUMMY = _MASHED | _LATIN
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_SENTENCE = re.compile(r"(?<=[.!?。！？…])(?:\s+|(?<=[。！？]))")
_MARKS = regex.compile(r"^(?:\s*(?:[#>]+|[-*+•]|\d+[.)])\s+|\s*[*_]+(?=\S))+")
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]{1,3}|[\p{L}\p{N}][\p{L}\p{N}\p{M}'’]*")
_LINK_ONLY = regex.compile(r"^\s*(?:[-*+]\s+|\d+[.)]\s+)?(?:\[[^\]\n]*\]\([^)\n]*\)[\s|·,/-]*)+$")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_TICKS = regex.compile(r"(`+)[^`\n].*?\1")
_FENCE = regex.compile(r"^\s*(```+|~~~+)")


def _is_filler(text: str) -> bool:
    """Words of typing exercises or of the usual dummy text, for the most part."""
    if _DUMMY.isdisjoint(plain_words(text)):
        return False
    words = _WORD.findall(text.lower())
    return len(words) >= 4 and sum(w in _DUMMY for w in words) >= 0.75 * len(words)


def kind_of(line: str, messages: Messages | None = None) -> int:
    """What a line is evidence of: every sentence of it must be a whole message of that sort."""
    text = _MARKS.sub("", line).strip()
    if not text:
        return NOTHING
    if _is_filler(text):
        return FILLER
    found = set()
    for bare in _SENTENCE.split(text):
        bare = bare.strip(_BARE)
        if not bare:
            continue
        kind = messages.kind(bare) if messages else NOTHING
        if kind == NOTHING:
            kind = next((k for k, pattern in _KINDS if pattern.fullmatch(bare)), NOTHING)
        if kind == NOTHING:
            return NOTHING
        found.add(kind)
    return next((k for k in (SCRIPT, ERROR, FILLER, HELP) if k in found), NOTHING)


def word_count(line: str) -> int:
    """Words of a line; scripts without spaces count two characters a word."""
    wide = 0 if line.isascii() else len(_WIDE.findall(line))
    return line.count(" ") + 1 + wide // 2


class Lines:
    """Kind, words and key of a line, remembered by a worker."""

    def __init__(self, messages: Messages) -> None:
        self.messages = messages
        self.seen: dict[tuple[str, int], tuple[int, int, int]] = {}

    def of(self, line: str, role: int) -> tuple[int, int, int]:
        known = self.seen.get((line, role))
        if known is None:
            kind = kind_of(line, self.messages) if role not in (LINK, CHROME) else NOTHING
            if role == CODE and kind not in (ERROR, NOTHING):
                kind = NOTHING
            known = (kind, word_count(line), xxhash.xxh64_intdigest(_NO_LETTERS.sub("", line.lower())) - (1 << 63))
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[line, role] = known
        return known


def markdown_lines(text: str) -> tuple[list[tuple[str, int]], bool]:
    """(line, role) of each line that is not blank; whether a placeholder stands outside code."""
    out, fence, bad = [], None, False
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if mark:
            fence = None if fence and line.strip().startswith(fence) else fence or mark.group(1)[:3]
            continue
        if not line.strip():
            continue
        if fence:
            out.append((line, CODE))
            continue
        if not bad and maybe_placeholder(line) and has_placeholder(_TICKS.sub(" ", line)):
            bad = True
        role = HEADING if line.lstrip().startswith("#") else LINK if _LINK_ONLY.match(line) or line.lstrip().startswith("|") else PLAIN
        out.append((line.strip(), role))
    return out, bad


_HIDDEN = regex.compile(r"<!--.*?-->|<(script|style|template|textarea|svg|select|iframe)\b.*?</\1\s*>|<(\w+)\b[^>]*?\s(?:hidden(?=[\s>=])|style=[\"']?[^\"'>]*(?:display:\s*none|visibility:\s*hidden))[^>]*>.*?</\2\s*>", regex.S | regex.I)
_NOSCRIPT = regex.compile(r"<noscript\b[^>]*>(.*?)</noscript\s*>", regex.S | regex.I)
_TAG = regex.compile(r"<(/?)([a-zA-Z][\w:-]*)([^>]*)>|<[!?][^>]*>")
_CHROME_TAGS = frozenset(("nav", "header", "footer", "aside", "form"))
_INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s samp small span strong sub sup tt u var wbr label".split())


def html_lines(html: str) -> tuple[list[tuple[str, int]], bool]:
    """(line, role) of each piece of visible text of a page; whether a placeholder stands outside code.

    Scripts, styles, templates, comments and hidden elements are not read. Text in ``noscript`` counts only where
    the page shows no other text than its title.
    """
    notices = [regex.sub(r"<[^>]+>", " ", m.group(1)).strip() for m in _NOSCRIPT.finditer(html)] if "<noscript" in html.lower() else []
    html = _HIDDEN.sub(" ", _NOSCRIPT.sub(" ", html) if notices else html)
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    code, chrome, heading, link, linked, plain, bad = 0, 0, 0, 0, False, False, False

    def flush() -> None:
        nonlocal linked, plain
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                role = CODE if code else CHROME if chrome else HEADING if heading else LINK if linked and not plain else PLAIN
                out.append((text, role))
            buffer.clear()
        linked = plain = False

    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            text = html[at : m.start()]
            if not text.isspace():
                text = unescape(text) if "&" in text else text
                if not code and not bad and has_placeholder(text):
                    bad = True
                buffer.append(text)
                if link:
                    linked = True
                elif any(c.isalnum() for c in text):
                    plain = True
            elif buffer:
                buffer.append(" ")
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        name, step = name.lower(), -1 if m.group(1) else 1
        if name in _INLINE:
            if name == "a":
                link = max(0, link + step)
            elif name == "code":
                code = max(0, code + step)
            continue
        flush()
        if name == "pre":
            code = max(0, code + step)
        elif name in _CHROME_TAGS:
            chrome = max(0, chrome + step)
        elif name == "title" or (len(name) == 2 and name[0] == "h" and name[1] in "123456"):
            heading = max(0, heading + step)
        elif name == "th" or name == "td":
            pass
    rest = html[at:].strip()
    if rest:
        bad = bad or (not code and has_placeholder(rest))
        buffer.append(unescape(rest))
        plain = True
    flush()
    if notices and not any(role in (PLAIN, CODE, CHROME) for _, role in out):
        out += [(unescape(n), PLAIN) for n in notices if n]
    return out, bad


_SCHEMA = "record_table string, record_id bigint, host_id bigint, bad boolean, evidence boolean, keys array<bigint>, kinds array<int>, words array<int>, roles array<int>"


def _read(df: DataFrame, name: str, id_col: str, url_col: str, text_col: str, title_col: str | None, html: bool, messages: Messages) -> DataFrame:
    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    source = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.when(site_of(F.col(url_col)).isNotNull(), F.xxhash64(site_of(F.col(url_col)))).alias("host_id"), F.col(text_col).alias("t"), title.alias("title"))
    source = source.where("t is not null and trim(t) != ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines(messages)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text, head in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                parts, bad = html_lines(text) if html else markdown_lines(text)
                bad = bad or (head is not None and has_placeholder(_TICKS.sub(" ", head)))
                facts = [lines.of(line, role) for line, role in parts]
                for c, v in zip(cols, (bad, any(k in (ERROR, SCRIPT, FILLER) for k, _, _ in facts), [k for _, _, k in facts], [k for k, _, _ in facts], [w for _, w, _ in facts], [r for _, r in parts])):
                    c.append(v)
            n = batch.num_rows
            kinds = [pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            arrays = [pa.array([name] * n, pa.string()), batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return source.mapInArrow(run, _SCHEMA)


def corpus_sentences(scrapes: DataFrame, id_col: str = "scrape_id", text_col: str = "markdown") -> list[str]:
    """Sentences of the long ones of the records with the lowest hashes, none of them a message in form: what the model must not take for one."""
    chosen = scrapes.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("bigint")).alias("h"), F.col(text_col).alias("t"))
    lowest = chosen.select("h").distinct().orderBy("h").limit(TRAINING_RECORDS).collect()  # hashes first: texts go nowhere but those
    if not lowest:
        return []
    rows = chosen.where(F.col("h") <= lowest[-1].h).collect()
    lines: dict[str, None] = {}
    for r in sorted(rows):
        own = [line for line, role in markdown_lines(r.t)[0] if role in (PLAIN, HEADING)]
        if sum(map(word_count, own)) >= TRAINING_WORDS:
            lines |= dict.fromkeys(own)
    plain = (_MARKS.sub("", line).strip() for line in lines if kind_of(line) == NOTHING)
    return sorted({x.strip(_BARE) for line in plain for x in _SENTENCE.split(line) if x.strip(_BARE)})


def find_residue(pages: DataFrame, scrapes: DataFrame) -> DataFrame:
    """``(record_table, record_id, reason, content_words)`` of every case, once.

    ``reason`` is placeholder, error, script or filler (the first that holds). Null and blank texts are no cases;
    rows delivered twice count once; records without a host have no boilerplate subtracted; an empty table gives
    nothing. One pass over the texts; of each line only its key, kind and length go further, and are shuffled once by
    record. The evidence model is trained on the driver against sentences of ``TRAINING_RECORDS`` scrapes.
    """
    messages = train_messages(corpus_sentences(scrapes))
    read = _read(pages, "pages", "page_id", "url", "html", None, True, messages).unionByName(_read(scrapes, "scrapes", "scrape_id", "url", "markdown", "title", False, messages))
    read = settle(read.dropDuplicates(["record_table", "record_id"]))  # before any word, line or record is counted
    hosts = read.groupBy("host_id").agg(F.count(F.lit(1)).alias("records"))
    suspects = read.where("evidence and not bad")
    # only the lines of suspects need counts; their keys are counted over all records of their hosts
    asked = settle(suspects.select("host_id", F.explode("keys").alias("key")).distinct())
    counted = read.select("host_id", F.explode(F.array_distinct("keys")).alias("key")).join(if_small(asked), ["host_id", "key"], "left_semi")
    often = (F.col("n") >= RECURRENT_RECORDS) & (F.col("n") >= F.col("records") * RECURRENT_SHARE)
    counted = counted.groupBy("host_id", "key").agg(F.count(F.lit(1)).alias("n")).join(hosts, "host_id")
    recurrent = settle(counted.where(often).select("host_id", "key", F.lit(True).alias("recurrent")))
    record = ["record_table", "record_id"]
    lines = suspects.select(*record, "host_id", F.explode(F.arrays_zip("keys", "kinds", "words", "roles")).alias("l"))
    lines = lines.select(*record, "host_id", F.col("l.keys").alias("key"), F.col("l.kinds").alias("kind"), F.col("l.words").alias("words"), F.col("l.roles").alias("role"))
    lines = lines.join(if_small(recurrent), ["host_id", "key"], "left")
    content = F.when((F.col("kind") == NOTHING) & F.col("role").isin(PLAIN, CODE) & F.col("recurrent").isNull(), F.col("words")).otherwise(0)
    sums = settle(lines.groupBy(*record).agg(
        F.sum(content).alias("content_words"),
        F.sum(F.when(F.col("kind") == FILLER, F.col("words")).otherwise(0)).alias("filler_words"),
        F.collect_set(F.when(F.col("kind").isin(ERROR, SCRIPT, FILLER), F.struct("host_id", "key", "kind"))).alias("shown")))
    shown = sums.select(*record, "content_words", F.explode("shown").alias("s")).select(*record, "content_words", "s.*")
    # a notice that recurs beside content is a part of its host's pages and stands in place of nothing
    beside = shown.where(F.col("content_words") > MOST_CONTENT_WORDS).groupBy("host_id", "key").agg(F.count(F.lit(1)).alias("n")).join(hosts, "host_id")
    notices = settle(beside.where(often).select("host_id", "key"))
    evidence = shown.join(if_small(notices), ["host_id", "key"], "left_anti").groupBy(*record).agg(*(F.max((F.col("kind") == k).cast("int")).alias(f"k{k}") for k in (ERROR, SCRIPT, FILLER)))
    alone = F.col("content_words") <= MOST_CONTENT_WORDS
    reason = F.when(alone & (F.col(f"k{ERROR}") == 1), "error").when(alone & (F.col(f"k{SCRIPT}") == 1), "script").when((F.col(f"k{FILLER}") == 1) & (alone | (F.col("filler_words") >= FILLER_SHARE * F.col("content_words"))), "filler")
    found = sums.join(evidence, record).withColumn("reason", reason).where("reason is not null").select(*record, "reason", "content_words")
    placeholders = read.where("bad").select(*record, F.lit("placeholder").alias("reason"), F.lit(None).cast("bigint").alias("content_words"))
    return found.unionByName(placeholders).dropDuplicates(record)
