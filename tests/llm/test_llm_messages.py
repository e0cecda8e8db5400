"""The evidence model of problem 3 on messages that its grammar does not make."""

import pytest

from tessera.llm import p3_messages, p3_residue
from tessera.llm.p3_messages import ERROR, NOTHING, SCRIPT

#: Messages written apart from the grammar of the model.
UNSEEN = """
Hmm, that page has wandered off
The page you wanted isn't here any more
Oh no! We can't find that page.
Looks like this page went missing
404 – we couldn't find what you need
This page doesn't seem to exist
The requested URL was not found on this server.
We looked everywhere but couldn't find this page
Oops! That page can't be found.
Sorry, the page you were trying to view does not exist.
This link might be broken
That article has been deleted
This video is no longer available
The file you requested has been moved or deleted
Whoops, looks like something went wrong.
Something went terribly wrong
An unexpected error has happened
An error occurred while processing your request
Our servers are currently overloaded
The server encountered an internal error and was unable to complete your request
The service is temporarily offline
We're down for maintenance
The website is currently under maintenance
502 Bad Gateway
503 Service Temporarily Unavailable
500 Internal Server Error
403 Forbidden
401 Unauthorized
Error 404: page not found
HTTP Error 400. The request is badly formed.
You don't have permission to access this resource.
Access to this site has been blocked
Your request has been denied
Your IP address has been blocked
Too many requests from your network
You have exceeded the request limit
Your session has timed out, please log in again
Connection to the database failed
The database is not available
Error establishing a database connection
The gateway did not respond in time
This site can't be reached
The connection was reset
Request timed out
We have lost this page
Nothing was found at this location
There is no page at this address
This content isn't available right now
This listing has expired
The document could not be opened
You'll need JavaScript switched on to read this
You need to enable JavaScript to run this app.
Please turn on JavaScript and reload the page
JavaScript seems to be disabled in your browser
This website requires JavaScript to work properly
Your browser does not have JavaScript enabled
Scripts are blocked in your browser
This application does not work without JavaScript
Enable scripts to continue
Please allow JavaScript to see the content of this page
Please come back in a few minutes
Please check the URL and try again
Our engineers are looking into the problem
Return to the homepage
Try reloading the page
JavaScript muss aktiviert sein, um diese Seite zu nutzen
Bitte schalten Sie JavaScript in Ihrem Browser ein
Diese Anwendung benötigt JavaScript
Die von Ihnen gesuchte Seite existiert leider nicht
Diese Seite wurde leider nicht gefunden
Der Inhalt ist nicht mehr verfügbar
Der Server antwortet derzeit nicht
Zugriff auf diese Seite verweigert
Es ist ein technischer Fehler aufgetreten
Bitte versuchen Sie es in einigen Minuten erneut
La page que vous recherchez est introuvable
Désolé, cette page n'existe plus
Le serveur a rencontré une erreur interne
Accès à cette page refusé
Ce contenu n'est plus disponible
Veuillez activer JavaScript pour afficher cette page
Le service est actuellement indisponible
Страница куда-то пропала
К сожалению, такой страницы не существует
Запрашиваемая страница не найдена
Сервер временно не отвечает
Доступ к этой странице ограничен
На сервере произошла ошибка
Для просмотра страницы включите JavaScript
В вашем браузере отключён JavaScript
На жаль, сторінку не знайдено
Ця сторінка більше не існує
Сервер тимчасово не відповідає
Доступ до сторінки заборонено
La página que busca no existe
Lo sentimos, no hemos encontrado esta página
El servidor no está disponible en este momento
Se ha producido un error en el servidor
Active JavaScript en su navegador
A página que procura não existe
Lamentamos, esta página não foi encontrada
O servidor está temporariamente indisponível
Ocorreu um erro no servidor
Ative o JavaScript no seu navegador
Strona, której szukasz, nie istnieje
Niestety ta strona nie została znaleziona
Serwer jest chwilowo niedostępny
Wystąpił nieoczekiwany błąd serwera
Włącz JavaScript w przeglądarce
お探しのページは見つかりませんでした
このページは存在しないか削除されました
サーバーでエラーが発生しました
ただいまアクセスが集中しています
JavaScriptを有効にしてください
Your headline goes here
Add your own text here
This is placeholder content
Replace this paragraph with your own content
Insert your description here
Content coming soon
Hier steht später Ihr Text
"""
#: Sentences that are content, some of them about such messages.
CONTENT = """
The museum is closed on Mondays and on public holidays
Our crawler found twelve pages that return an error
The new bridge was not available to lorries until May
Bitte bringen Sie zur Wanderung feste Schuhe mit
Le serveur apporte la carte et propose un dessert
Сервер стоит в подвале старого здания библиотеки
The request log lists every page that was removed last year
Wir haben die Seite des Vereins neu gestaltet
You can find the list of members in the annex
JavaScript is a language that runs in browsers and on servers
"""


@pytest.fixture(scope="module")
def messages():
    return p3_messages.train_messages(["The price list compares the weather table before the browser starts", "A patient operator removes the broken image from the archive"])


def test_unseen_messages_are_found(messages):
    unseen = UNSEEN.strip().splitlines()
    assert len(unseen) >= 100
    assert sum(p3_residue.kind_of(x, messages) != NOTHING for x in unseen) >= 0.9 * len(unseen)


def test_content_is_no_message(messages):
    assert [x for x in CONTENT.strip().splitlines() if p3_residue.kind_of(x, messages) != NOTHING] == []


def test_kinds_and_length(messages):
    assert p3_residue.kind_of("You'll need to enable JavaScript in your browser.", messages) == SCRIPT
    assert p3_residue.kind_of("Sorry, this page could not be found.", messages) == ERROR
    assert p3_residue.kind_of("Sorry, this page could not be found. " * 40, messages) == ERROR  # however long it is
    assert p3_residue.kind_of("Sorry, this page could not be found. The museum opens at nine.", messages) == NOTHING


def test_a_notice_beside_content_of_its_host_is_boilerplate(spark):
    banner, story = "Please enable JavaScript in your browser.", " ".join(f"harbour {chr(97 + k % 26)} boats" for k in range(40))
    rows = [(k, f"https://h.example/{k}", "t", f"{banner}\n{story} {chr(97 + k) * 5}") for k in range(8)]
    rows += [(90, "https://h.example/90", "t", f"{banner}\nshort page"), (91, "https://other.example/91", "t", f"{banner}\nshort page"), (92, "https://h.example/92", "t", "Sorry, this page could not be found.")]
    scrapes = spark.createDataFrame(rows, "scrape_id bigint, url string, title string, markdown string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert {(r.record_id, r.reason) for r in p3_residue.find_residue(pages, scrapes).collect()} == {(91, "script"), (92, "error")}


@pytest.mark.parametrize("text", ["Hello [Name], welcome", "Dear $FIRST_NAME", "[PLACEHOLDER]", "{{ customer.first_name | default: 'a friend whose name nobody knows' }}"])
def test_placeholders_of_any_length(text):
    assert p3_residue.markdown_lines(text)[1]
