"""Phrase families of error pages, script notices and filler, in seven languages.

A family is written as one line: ``(a|b)`` is one of several wordings, ``[a]`` an optional one, and every combination is a
phrase. All are folded: lower case, no accents, straight apostrophes, no stop at the end. ``PAGE`` phrases make a page
an error page or a notice where they cover it; ``BESIDE`` phrases come with them and count towards the coverage, but make
nothing by themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from http import HTTPStatus
from itertools import product

_PART = re.compile(r"\(([^()]*)\)|\[([^\[\]]*)\]|([^()\[\]]+)")


def wordings(family: str) -> Iterator[str]:
    """Every phrase of a family."""
    parts = []
    for one_of, maybe, plain in _PART.findall(family):
        parts.append(one_of.split("|") if one_of else ["", *maybe.split("|")] if maybe else [plain])
    for chosen in product(*parts):
        yield " ".join("".join(chosen).split())


def phrases(families: str) -> set[str]:
    return {w for line in families.strip().split("\n") for w in wordings(line)}


#: Reasons that are everyday words alone count with their number only.
_EVERYDAY = {"gone", "conflict", "locked", "loop detected", "not extended", "not implemented", "insufficient storage"}


def statuses() -> set[str]:
    """How pages write the error statuses of HTTP."""
    out = set()
    for s in HTTPStatus:
        if s.value >= 400:
            reason = s.phrase.lower()
            out.add(reason.replace("timeout", "time-out"))
            out |= {
                f"{s.value} {reason}", f"{reason} {s.value}",
                *(
                    f"{x} {s.value}"
                    for x in ("error", "error code", "http", "http error", "http status", "status code", "fehler", "erreur", "errore", "erro", "fout")
                )
            }
            out |= {f"{s.value} error", f"{s.value}: {reason}", f"{s.value} - {reason}", f"{s.value} – {reason}"}
            if reason not in _EVERYDAY:
                out.add(reason)
    return out


SCRIPT_NOTICES = """
(page|site|website|web site|app|application|viewer|tool|service|form|demo|portal|content) (requires|needs|uses|relies on|depends on|works only with|only works with|won't work without|does not work without|doesn't work without|will not work without|cannot run without|can't run without) [active |a browser with ](javascript|js|scripts|scripting|client-side scripting|javascript and cookies|cookies and javascript)[ enabled| to be enabled| to be allowed| allowed| on| turned on| to run| to work| to function]
(enable|turn on|switch on|activate|allow|re-enable) (javascript|js|scripts|scripting|javascript and cookies|cookies and javascript|cookies and scripts|active scripting)
(javascript|js|scripts|scripting|client-side scripting) (is|are|must be|has to be|have to be|seems to be|appears to be|needs to be|should be) (disabled|off|turned off|switched off|blocked|required|enabled|turned on|switched on|on|allowed|not enabled|not supported|not available|needed)
your browser (does not support|doesn't support|has disabled|is blocking|blocks|does not allow) (javascript|js|scripts|scripting)
without (javascript|js|scripts|scripting)
noscript
(checking|verifying) your browser before (opening|accessing|loading|entering|continuing to) (the|this) (page|site|website)
(checking|verifying) (your browser|if the site connection is secure|that you are human|you are human|you are not a robot)
[please ]verify [that ]you are (human|not a robot|a human)
(diese|die) (seite|website|webseite|anwendung|app) (benotigt|erfordert|braucht|verwendet) [aktives |aktiviertes ](javascript|skripte)
aktivieren sie (javascript|skripte|cookies und javascript|javascript und cookies)
(javascript|skripte) (ist|sind|muss|mussen|scheint) [in ihrem browser ](deaktiviert|ausgeschaltet|abgeschaltet|erforderlich|nicht aktiviert|aktiviert sein|eingeschaltet sein|aktiviert werden|blockiert)
ihr browser unterstutzt kein javascript
(ce|cette|ce|notre|le|la) (site|site web|page|application) (necessite|requiert|a besoin de|utilise|exige) (javascript|que javascript soit active|des scripts|scripts actifs|des scripts actifs)
(activer|activez|autoriser|autorisez|reactiver) [le ](javascript|les scripts)
javascript (est|doit etre|semble|semble etre) [actuellement ](desactive|active|requis|bloque|necessaire|obligatoire)
votre navigateur ne (supporte pas|prend pas en charge|gere pas) [le ]javascript
(este|esta|el|la|nuestro|nuestra) (sitio|sitio web|pagina|pagina web|aplicacion|web) (requiere|necesita|utiliza|usa) (javascript|scripts)
(active|activa|habilite|habilita|activar|habilitar|permita) (javascript|los scripts)
javascript (esta|debe estar|parece estar) (desactivado|deshabilitado|habilitado|activado|bloqueado)
su navegador no (soporta|admite|es compatible con) javascript
(este|esta|o|a|nosso) (site|pagina|aplicacao|aplicativo|aplicativo web) (requer|precisa de|necessita de|exige|usa) javascript
(ative|habilite|ativar|habilitar|active|ligue) o javascript
(ative|habilite|ativar|habilitar|ligue) javascript
javascript (esta|deve estar|precisa estar) (desativado|desabilitado|ativado|habilitado)
[o ]seu navegador nao suporta javascript
(deze|de|onze) (website|pagina|site|app|applicatie|webpagina) (vereist|gebruikt|werkt niet zonder|heeft) javascript[ nodig]
schakel javascript in
zet javascript aan
javascript (is|staat|moet) (uitgeschakeld|uit|ingeschakeld zijn|aan staan|ingeschakeld worden|geblokkeerd)
uw browser ondersteunt geen javascript
(questo|questa|il|la|il nostro) (sito|sito web|pagina|applicazione|app) (richiede|necessita di|ha bisogno di|utilizza|usa) javascript
(abilita|attiva|abilitare|attivare|abilitate|attivate|abiliti) javascript
javascript (e|deve essere|sembra) (disabilitato|disattivato|abilitato|attivato|bloccato|richiesto)
il (tuo|suo|vostro) browser non supporta javascript
"""

ERROR_PAGES = """
[requested ](page|file|document|resource|content|item|article|url|site|address|entry) (not found|was not found|could not be found|cannot be found|can't be found|couldn't be found|does not exist|doesn't exist|no longer exists|is not available|is unavailable|no longer available|is no longer available|has been removed|has been deleted|was removed|was deleted|has moved|was moved|does not exist or was moved|can't be displayed|cannot be displayed|can't be reached|cannot be reached|isn't working|is not working)
(page|file|document|resource|content|item|article|url|site) (you are looking for|you were looking for|you requested|you have requested|you are trying to reach|you tried to reach) (not found|was not found|could not be found|cannot be found|can't be found|couldn't be found|does not exist|doesn't exist|no longer exists|is not available|is unavailable|no longer available|is no longer available|has been removed|has been deleted|has moved|was moved|may have been moved)
we (couldn't|could not|can't|cannot|were unable to) find (the page|that page|this page|what you were looking for|what you are looking for|what you're looking for|the page you were looking for|the page you are looking for|the page you requested)
(something|it looks like something) (went wrong|has gone wrong)
(an|a|an unexpected|an internal|an unknown|an application|a server|a technical) (error|problem|exception) (occurred|has occurred|was encountered|happened)
[a ](client-side|server-side|unhandled) exception [has ]occurred
(internal server|server|application|database connection|database|gateway|proxy|fatal|internal|unexpected|unknown|network) error
error establishing a database connection
[the |a ]connection to the database could not be established
(service|server|site|website|application|app|system) (is|is currently|is temporarily|temporarily|currently) (unavailable|not available|down|offline|overloaded|unable to service your request|out of service|down for maintenance|undergoing maintenance|under maintenance)
service temporarily unavailable
[we are |we're |we are currently |site is ](down for maintenance|under maintenance|undergoing maintenance|performing maintenance|performing scheduled maintenance|undergoing scheduled maintenance)
(maintenance mode|scheduled maintenance)
[we |we'll |we will |and ](be back soon|be back shortly|will be back soon|will be back shortly)
access [is |was |has been ](denied|forbidden|restricted)
permission denied
you (do not|don't) have (permission|access|the rights|sufficient rights|the necessary permissions|the required permissions)[ to access| to view| to open| to see][ this| the| the requested][ page| resource| document| content| file| directory| server| site]
you are not (authorized|authorised|allowed|permitted) to (access|view|open|see|visit) (this|the|the requested) (page|resource|document|content|file|directory|site|area)
(authorization|authentication|login) required
your session (has expired|expired|has timed out|timed out|has ended)
[the |your ](request|connection|operation|server|gateway|upstream request) [has ]timed out
rate limit exceeded
your request could not be (processed|completed|handled|fulfilled)
not available in your (country|region|location|area)
the server (encountered|has encountered|returned|reported) an (internal|unexpected) (error|condition)
the server (did not|didn't) respond[ in time]
[and ](could not|was unable to) complete your request
this (account|site|website|domain) (has been|is) (suspended|disabled|parked|blocked)
[die |diese |die angeforderte |die gesuchte |die von ihnen gesuchte |die aufgerufene ](seite|datei|ressource|adresse) (nicht gefunden|wurde nicht gefunden|konnte nicht gefunden werden|existiert nicht|existiert nicht mehr|ist nicht verfugbar|ist nicht erreichbar|gibt es nicht)
(es ist ein fehler aufgetreten|ein fehler ist aufgetreten|es ist ein unerwarteter fehler aufgetreten|ein unerwarteter fehler ist aufgetreten|etwas ist schiefgelaufen|etwas ist schief gelaufen|da ist etwas schiefgelaufen)
(interner serverfehler|serverfehler|interner fehler|datenbankfehler)
[der |die ](dienst|service|server|seite|website) [ist ][derzeit |vorubergehend |zurzeit |momentan ](nicht verfugbar|nicht erreichbar|uberlastet)
(zugriff|zugang) (verweigert|verboten|nicht erlaubt|nicht gestattet)
sie haben keine (berechtigung|rechte|zugriffsrechte)
ihre (sitzung|session) ist abgelaufen
(wartungsarbeiten|wartungsmodus|wegen wartung geschlossen)
zu viele anfragen
[la |cette ](page|ressource|adresse) (introuvable|non trouvee|inexistante|n'existe pas|n'existe plus|est introuvable|n'est pas disponible|n'est plus disponible)
la page (demandee|que vous recherchez|que vous cherchez|que vous demandez|recherchee) (n'existe pas|n'existe plus|est introuvable|n'a pas ete trouvee|est indisponible|n'est pas disponible|n'a pu etre trouvee)
une erreur [inattendue |interne ](est survenue|s'est produite|inattendue s'est produite)
(erreur interne|erreur interne du serveur|erreur serveur|quelque chose s'est mal passe)
[le |ce |notre ](service|site|serveur) [est ][temporairement |actuellement |momentanement ](indisponible|inaccessible|en maintenance)
acces (refuse|interdit|non autorise)
vous n'avez pas (l'autorisation|la permission|les droits|acces|les autorisations)
votre session a expire
(maintenance en cours|trop de requetes)
[la |esta ](pagina|direccion) (no encontrada|no existe|no disponible|no esta disponible|no se encuentra)
la pagina (solicitada|que busca|que buscas|que buscaba|que esta buscando|que estas buscando) (no existe|no se encuentra|no se encontro|no esta disponible|no se ha encontrado|ya no existe)
(ha ocurrido|se ha producido|ocurrio|se produjo|hubo) un (error|problema)[ inesperado]
(algo salio mal|algo ha salido mal)
(error interno|error interno del servidor|error del servidor)
[el ](servicio|sitio|servidor) [temporalmente |actualmente ](no disponible|no esta disponible|fuera de servicio)[ temporalmente]
acceso (denegado|prohibido|restringido|no autorizado)
no (tiene|tienes) (permiso|permisos|acceso|autorizacion)
su sesion ha (caducado|expirado)
(en mantenimiento|demasiadas solicitudes)
[a |esta ]pagina (nao encontrada|nao existe|nao foi encontrada|nao esta disponivel)
a pagina (solicitada|que voce procura|que voce procurou|que voce esta procurando|que procura) nao (existe|foi encontrada|esta disponivel)
(ocorreu|houve) um (erro|problema)[ inesperado]
(algo deu errado|algo correu mal|erro interno|erro interno do servidor|erro do servidor)
[o ]servico [esta ](indisponivel|temporariamente indisponivel)
acesso (negado|proibido|restrito|nao autorizado)
[voce ]nao tem (permissao|acesso|autorizacao)
[a ]sua sessao expirou
em manutencao
[de |deze ](pagina|bestand|webpagina) (niet gevonden|bestaat niet|bestaat niet meer|is niet gevonden|is niet beschikbaar)
[de ]pagina die (u|je) (zoekt|zocht) (bestaat niet|is niet gevonden|kan niet worden gevonden|kon niet worden gevonden)
(er is een fout opgetreden|er is een onverwachte fout opgetreden|er ging iets mis|er is iets misgegaan|interne serverfout)
[de ](service|dienst|site|website|server) [is ][tijdelijk |momenteel ](niet beschikbaar|niet bereikbaar)
toegang (geweigerd|verboden)
(u hebt|u heeft|je hebt) geen (toegang|rechten|toestemming)
uw sessie is verlopen
[la |questa ]pagina (non trovata|non disponibile|non esiste|inesistente)
la pagina (richiesta|che cerchi|che stai cercando|che state cercando|cercata) non (esiste|e stata trovata|e disponibile)
(si e verificato|e stato riscontrato) un (errore|problema)[ imprevisto]
(qualcosa e andato storto|errore interno|errore interno del server|errore del server)
[il ](servizio|sito|server) [e ][temporaneamente |al momento ](non disponibile|non raggiungibile)
accesso (negato|vietato|non autorizzato)
non (hai|ha|avete) (i permessi|il permesso|l'autorizzazione|accesso)
la (tua|sua|vostra) sessione e scaduta
in manutenzione
"""

BESIDE = """
[we are |we're |we ](sorry|very sorry|oops|ooops|whoops|uh oh|apologize|apologise)
(sorry|we apologize|we apologise) for [the |any ]inconvenience
[please |or ](try again|retry|try again later|try again in a few minutes|try again shortly|try later|slow down)[ later]
[please ](reload|refresh|reload the page|refresh the page|and reload|then refresh|then reload|and reload the page|and refresh the page)
[please ](contact|contact the|contact your|contact our|notify the) (administrator|support|webmaster|site owner|system administrator|site administrator|support team)
[please ](go|go back|return|back|go to|take me|click here to return) [back ]to [the ](home page|homepage|start page|home|start|previous page|main page|startpage)
(go to|visit) [the |our ](home page|homepage|start page)
(you are|you were) looking for
(you may have|you might have) mistyped the (address|url)
[or ]the page may have (moved|been moved|been removed|been deleted)
[please ]check the (url|address|spelling|address and try again)
if you (think|believe) this is (an error|a mistake)
(just a moment|one moment please|please wait|at this time|at the moment|right now|on this server|the requested|and try again|in a few minutes|log in again|sign in again|thank you for your patience|for the best experience|work properly|properly|please)
(error code|error number|request id|reference number|ray id|incident id|trace id)
due to (maintenance downtime or capacity problems|maintenance|high load|technical problems)
[in |on ]your (browser|browser settings|settings|device)
(in order to|to) (continue|proceed|run this app|run this application|use this site|use this page|use this website|use this app|use it|view this page|view this site|view this content|see this content|view it|access this page|see it|work|function|run)
[in order |in order for you ]to (use|view|access|see|visit) (this|the|our) (site|page|website|app|content|application)
(turn|switch) (it|them) on
(by completing the action below|complete the security check|for full functionality|full functionality of this site|cookies and|and cookies|cannot load|can't load|will not work|won't work)
(nginx|apache|cloudflare|openresty|varnish cache server|iis|tomcat|lighttpd|caddy)
(leider|entschuldigung|es tut uns leid|bitte|um fortzufahren|in ihrem browser|diese seite anzuzeigen|zur startseite|zuruck zur startseite|wir sind bald wieder da)
[bitte ]versuchen sie es (spater|erneut|noch einmal|spater erneut|spater noch einmal|spater wieder)
um diese (seite|website|anwendung|app) zu (nutzen|sehen|verwenden|besuchen|laden)
(desole|oups|nous sommes desoles|veuillez|dans votre navigateur|retour a l'accueil|d'acceder a cette page|de consulter cette page|pour continuer|merci de|plus tard|l'activer)
(veuillez reessayer|reessayez)[ plus tard]
pour (continuer|fonctionner|afficher cette page|utiliser ce site|utiliser cette application|acceder a cette page)
(lo sentimos|disculpe|por favor|en su navegador|volver al inicio|mas tarde|para ver esta pagina|de nuevo|para continuar)
(intentelo|intentalo|intente|vuelva a intentarlo)[ de nuevo][ mas tarde]
para (continuar|ver esta pagina|usar este sitio|utilizar este sitio|usar este site|usar esta pagina|acceder|utilizar esta aplicacion)
(desculpe|lamentamos|no seu navegador|mais tarde|voltar ao inicio|pagina inicial)
tente novamente[ mais tarde]
(sorry|helaas|in uw browser|terug naar de startpagina|terug naar home|om door te gaan)
probeer het (later|opnieuw|later opnieuw|nogmaals|later nog eens)
om deze (website|pagina|site|app) te (gebruiken|bekijken|bezoeken)
(ci dispiace|spiacenti|siamo spiacenti|nel tuo browser|torna alla home|torna alla pagina iniziale)
riprova[ piu tardi]
per (continuare|visualizzare questa pagina|utilizzare questo sito|usare questo sito|utilizzare questa applicazione)
"""

FILLER = """
[insert |enter |add |type |write |put |place ](your|some|the|a short|a brief|a) (text|content|description|title|heading|message|summary|copy|introduction|paragraph|caption|story) (here|goes here|below|in this box|in this field|in this section)
(insert|enter|add|type|write|put|place) (text|content|description|title|heading|message|summary|copy|image|caption) (here|below|in this box|in this field)
[body |some |more |main |sample |your |the ](text|content|copy|description|heading|title|headline|paragraph|caption) (goes here|to come|to follow|coming soon|to be added|comes here|will go here|will follow)
[this is |this is a |this is some |just |only ](placeholder|dummy|filler|sample|fake) (text|content|paragraph|copy|sentence)[ only| here]
(replace|change|edit|overwrite) (this|it|this paragraph|this text|this sentence|this content|it all) with your own (words|text|content|copy)
(used to show the layout|only for preview|for layout only|for preview only|please replace|about two or three lines|used for layout)
(coming soon|under construction|to be written|text follows|more text to follow|lorem text)
text text text
lorem ipsum[ dolor][ sit][ amet]
[hier steht |hier kommt |dies ist |das ist ][ein |nur |der ](blindtext|typoblindtext|platzhaltertext|beispieltext|mustertext|fulltext)
hier (steht|kommt|konnte|folgt) [bald |ihr |dein |spater ]text[ hin| stehen| folgen]
[bitte ](text|inhalt) (hier einfugen|folgt|hier eingeben)
bitte ersetzen
[ceci est |voici ][un |du ](faux texte|texte factice|texte de remplissage|texte d'exemple|texte exemple|texte a venir|texte a remplacer)[ a remplacer]
(votre|inserez votre|saisissez votre|ajoutez votre|ecrivez votre|inserez le|inserer) texte ici
contenu a venir
[este es |esto es |aqui va ][un |el ](texto de relleno|texto de ejemplo|texto de prueba|texto simulado|texto ficticio)
(su|tu|inserte su|escriba su|escribe tu|anada su|inserte el|inserte) texto aqui
(contenido proximamente|proximamente)
[este e |isto e ][um ](texto de exemplo|texto de preenchimento|texto ficticio|texto provisorio)
(seu|insira seu|insira o|escreva seu|digite seu|adicione seu|coloque seu) texto aqui
em breve
[dit is ][een |slechts ](voorbeeldtekst|opvultekst|plaatshoudertekst|testtekst)
(hier komt|hier staat) [uw |de |je ]tekst
(voeg|plaats|typ|zet|voer) hier (uw|je|de) tekst( toe|| in)
[questo e ][un ](testo di esempio|testo segnaposto|testo di prova|testo fittizio|testo riempitivo)
(inserisci|inserire|scrivi|aggiungi) qui il (tuo|suo|vostro) testo
[il ](tuo|suo|vostro) testo qui
prossimamente
"""

#: Words of idle hands; a line of nothing else is filler, the last ones only where they repeat.
MASH = "asdf asdfasdf asdfgh asdfghjkl qwer qwerty qwertz zxcv jkl hjkl fdsa blah bla xxx xxxx xxxxx xxxxxx xyz foo bar baz".split()
REPEATED = {"test", "testing", "text", "texto", "texte", "tekst", "testo", "teste", "prueba", "essai", "123", "1234"}

# What buttons and menus of such pages say.
NAVIGATION = """
home|home page|homepage|back|go back|back to start|back to home|return to home page|contact|contact us|help|search|reload|refresh|log in|login|sign in|menu|close|ok|retry|details|more|support|status|
zuruck|zur startseite|startseite|hilfe|suche|neu laden|anmelden|kontakt|
retour|accueil|retour a l'accueil|aide|rechercher|recharger|connexion|
volver|inicio|volver al inicio|ayuda|buscar|recargar|voltar|pagina inicial|ajuda|terug|startpagina|hulp|zoeken|indietro|pagina iniziale|aiuto|cerca
""".replace("\n", "").split("|")

# The usual dummy Latin.
DUMMY_LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo "
    "consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta explicabo nemo quia voluptas "
    "vestibulum ante primis faucibus orci luctus ultrices posuere cubilia curae pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas mauris donec maecenas aliquam facilisi integer "
    "curabitur phasellus suspendisse vivamus praesent nullam fusce cras proin quisque nam aenean etiam sagittis lacinia viverra tincidunt volutpat blandit dictum sem eros felis lectus ligula neque nisl nunc odio porta "
    "pretium purus quam rhoncus risus sapien sodales tellus tortor urna varius vel vehicula venenatis".split()
)
