"""Labelled exemplars of residue, and the concepts that different wordings share.

Exemplars are messages that servers, browsers, frameworks, editors and template languages are known for,
written from general knowledge; a caller may pass a labelled table of its own instead. Concepts fold the
words in which such messages vary (enable, activate, allow, ...) in the languages covered, so that one exemplar
stands for many wordings.
"""

from __future__ import annotations

#: How template languages write a slot. Only the skeleton counts; the name is arbitrary.
SLOTS = """
{{name}}
{{{name}}}
${name}
#{name}
%{name}
@{name}
{%name%}
{#name#}
<%name%>
<%=name%>
<?name?>
<?=name?>
[[name]]
[%name%]
<<name>>
{name}
@@name@@
##name##
__name__
%name%
$name$
:NAME:
%(name)s
%s
%d
[NAME_HERE]
<NAME_HERE>
[insert name here]
<insert name here>
(insert name here)
"""

#: Dummy and filler text of templates and editors.
FILLER = """
Your text here
Your text
Your title goes here
Text goes here
Your subtitle here
Type your text here
Insert text
Type something
Enter your message
Enter a description for this item
Click to add text
Click to edit
Double click to edit this text
Tap to add a title
Placeholder text
This is placeholder text
This is a sample text
This is dummy text
Dummy text, no content yet
Sample line
Sample text line
Dummy line
Replace this text before publishing
Replace before launch
Replace me
Change me
Needs translation
To be translated
Not translated yet
Untranslated string
Missing translation
Translation pending
TODO
TODO: translate this
FIXME
To be announced
To be added
No text yet available
Content coming soon
Coming soon
Text to follow
asdf
qwerty
xxxx
foo bar baz
Hier steht Text
Ihr Text hier
Platzhaltertext
Text folgt
Texto de ejemplo
Reemplazar este texto
Votre texte ici
Texte à venir
Texte de remplacement
Testo di esempio
Texto de exemplo
Voorbeeldtekst
Tekst volgt
Exempeltext
Przykładowy tekst
"""

#: The vocabulary of the usual dummy paragraph.
LOREM = """
lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui
officia deserunt mollit anim id est laborum
"""

#: Error and access messages of servers, sites and programs. 404 stands for any status number from 400 to 599.
ERRORS = """
Error 404
HTTP 404
HTTP Error 404
HTTP/1.1 404
Status code 404
404 Not Found
Not Found
Page not found
File not found
The requested URL was not found on this server
The requested resource could not be found
The page you are looking for does not exist
The page you are looking for has been moved or removed
This page could not be loaded
The file could not be loaded
This site can't be reached
This page isn't working
This content is no longer available
This video is unavailable
This content is not available in your country
Check the address and try again
Go back to the home page
Return to the start page
Please try again later
Please try again in a few minutes
Retry after 60 seconds
Too many requests
Too many requests, try again later
Rate limit exceeded
Daily limit reached
Download limit exceeded
Quota exceeded
404 Bad Request
Bad Request
404 Unauthorized
Unauthorized
Payment Required
404 Forbidden
Forbidden
You don't have permission to access this resource
You do not have permission to view this page
You are not authorized to view this page
Access denied
Access to this page has been denied
Permission denied
Method Not Allowed
404 Request Timeout
Request Timeout
404 Gone
Payload Too Large
404 Too Many Requests
404 Internal Server Error
Internal Server Error
Not Implemented
404 Bad Gateway
Bad Gateway
404 Service Unavailable
Service Unavailable
The server is temporarily unable to service your request
404 Gateway Timeout
Gateway Time-out
Web server is returning an unknown error
Connection timed out
Connection refused
Connection reset by peer
Connection closed
Could not connect to the server
The server did not respond
No response from the server
No answer from upstream host
The server took too long to respond
Host not found
Host unreachable
The connection to the server was lost
The server is overloaded
DNS error
Network error
Error establishing a database connection
Application error
An error occurred
An unexpected error occurred while processing your request
Error 1020
Error code 7: request failed
Something went wrong
Oops, something went wrong
Something went wrong on our end
We are working on it
We are working to fix the problem
Sorry for the inconvenience
Your IP address has been blocked
Your IP address has been logged
Your request has been blocked
This account has been suspended
Site under maintenance
Temporarily down for maintenance
We will be back soon
Session expired
Your session has expired, please log in again
Please sign in to continue
You must be logged in to view this page
Please log in to watch
Login required
Traceback (most recent call last)
Traceback (most recent call last): File main.py, line 1
Exception in thread main
Unhandled exception
Uncaught exception
Fatal error: Uncaught exception in main.php on line 1
GeneralException: in main.py line 1
SQLSTATE[00000]: General error
Warning: function() expects parameter to be resource, boolean given in main.php on line 1
Warning: mysql_fetch_array() supplied argument is not a valid result resource in main.php on line 1
Warning in main.php on line 1
Notice: Undefined variable in main.php on line 1
Parse error: syntax error, unexpected end of file in main.php on line 1
Segmentation fault (core dumped)
Stack trace
Out of memory
No space left on device
Apache Server at example.org Port 80
Request ID: 0123456789ab
Reference number: 0123456789ab
If the problem persists, contact the administrator
Please contact support
The request could not be completed
The requested file could not be retrieved
Invalid request
Invalid token
Failed to load resource
Failed to load
Unsupported format
Seite nicht gefunden
Datei nicht gefunden
Die angeforderte Seite existiert nicht
Zugriff verweigert
Interner Serverfehler
Ein Fehler ist aufgetreten
Dienst nicht verfügbar
Page introuvable
Fichier introuvable
La page demandée n'existe pas
Accès refusé
Erreur interne du serveur
Une erreur est survenue
Página no encontrada
Archivo no encontrado
Esta página ya no está disponible
Acceso denegado
Error interno del servidor
Se ha producido un error
Pagina non trovata
Accesso negato
Página não encontrada
Acesso negado
Sidan hittades inte
Nie znaleziono strony
"""

#: Notices that scripts, cookies, a browser or a check for robots stand before the content.
NOTICES = """
Please enable JavaScript to view this page
You need to enable JavaScript to run this app
JavaScript is required
JavaScript is disabled in your browser
JavaScript must be enabled
This page requires JavaScript to work properly
This site only works with JavaScript enabled
The video player needs JavaScript to run
Enable JavaScript and cookies to continue
Turn on JavaScript and reload the page
Scripts are blocked on this site
If nothing appears, enable scripts and reload
If the page does not load, allow scripts for this site
Loading, please wait
Loading content
This site requires cookies
This website uses cookies
We use cookies to improve your experience
Accept all cookies
Please enable cookies
Cookies are disabled in your browser
Your browser does not support JavaScript
Your browser does not support the video tag
Your browser is not supported
Your browser is out of date
Unsupported browser
Please update your browser
Please disable your ad blocker
Checking your browser
Checking your browser before accessing the site
Checking if the site connection is secure
DDoS protection
This process is automatic, your browser will redirect shortly
Verify you are human
Please wait while we verify
One moment please
Verifying that you are not a robot
Please prove that you are not a robot
Confirm you are human to continue
I am not a robot
Please complete the captcha to continue
Complete the security check to access the site
Unusual traffic from your computer network
Bitte aktivieren Sie JavaScript
Bitte aktivieren Sie JavaScript, um die Seite anzuzeigen
Ihr Browser wird nicht unterstützt
Veuillez activer JavaScript pour afficher la page
Votre navigateur n'est pas pris en charge
Habilite JavaScript para ver el contenido
Es necesario activar JavaScript para continuar
Su navegador no es compatible
Abilita JavaScript per continuare
Ative o JavaScript para continuar
Schakel JavaScript in om door te gaan
Aktivera JavaScript för att fortsätta
Włącz JavaScript, aby kontynuować
Включите JavaScript
"""

#: Words of one concept. A word ending in * stands for all that begin so.
CONCEPTS = """
enable enabl* activat* activer activez activar active aktivier* aktivera allow* permit* unblock* habilit* abilita ative schakel włącz włączyć
disable disabl* deactivat* deaktiviert desactivado désactivé
script javascript* script scripts scripting ecmascript
cookie cookie*
browser browser* navigateur navegador przeglądarka
human robot robots captcha* recaptcha bots roboter
verify verif* prove confirm* check checking
page page pages site sites website* webpage* seite página pagina sidan strona strony
file file files datei fichier archivo ficheiro bestand plik
resource resource* content contents contenido contenu inhalt conteúdo contenuto
show view display* afficher ver anzuzeigen anzeigen visualizzare visualizar
server server servers gateway proxy upstream backend node cache
answer answer* respon*
deliver deliver* retriev* fetch* served load* download* chargement cargar laden
absent unavailable missing introuvable gefunden encontrada encontrado trovata encontrada hittades znaleziono removed deleted moved
deny denied forbidden unauthori* refused reject* verweigert refusé denegado negado interdit prohibido blocked
retry retry retries reload refresh
need need needs require* requires necesita necesario necessary benötigt
run run runs running works
again continue proceed fortzufahren fortfahren continuer continuar continuare kontynuować fortsätta
limit limit* quota rate
fail fail* error* fehler erreur errore erro oops
expire expire* outdated
text text texts line lines string subtitle* caption* texto texte testo tekst untertitel
speech dialogue dialog cue cues description message
dummy dummy placeholder* sample example filler beispiel* platzhalter* ejemplo exemple esempio exemplo voorbeeld* exempel* przykład*
enter type enter insert insertar introduce escriba saisissez inserisci insira skriv wpisz eingeben
replace replace* reemplazar sustituir sustituya ersetzen remplacer remplacement sostituire
publish publish* release launch
translate translat* untranslated
login login log* sign* session password account
stand steht stehen
later later moment shortly
product player viewer app application
"""


#: Words of people about people, which count in full against a passage.
TALK = "he she they him her them his hers their mine myself himself herself sir madam mom dad darling"


def labelled() -> list[tuple[str, str]]:
    """(kind, text) of each exemplar but the dummy paragraph."""
    blocks = (("slot", SLOTS), ("filler", FILLER), ("error", ERRORS), ("notice", NOTICES))
    return [(kind, line) for kind, block in blocks for line in block.strip().splitlines()]
