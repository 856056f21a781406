"""Template residue, filler, default titles and error or check pages instead of a title.

Titles are cut into lines at separators. Normalised lines are counted by host; those that
recur in other titles, there or on other hosts, are boilerplate (site and brand names)
and are subtracted, as are the host's own name and the name in the page's address. A title
whose residual is evidence, and nothing else, is no title. Evidence must match a whole
line, so a real title that mentions such words stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.urls import squeeze
from anchorloom.operators.current import current_rows
from anchorloom.operators.skew import lookup
from anchorloom.runtime import Workspace, spread

#: A line is boilerplate if it stands in at least this many different titles, of its host or of all.
RECURRENT = 3
#: Names may stand without a separator in other titles: as their first words, at most this many.
NAME_WORDS = 3

# --- Fixed values: the vocabulary of pages that are no content, as patterns on a lower-case
# line with straight apostrophes and without trailing marks. Each must match the whole line.
_CODE = r"(?:4\d\d|5\d\d)"
_THING = r"(?:page|site|website|web page|web site|shop|store|document|file|item|product|resource|article|address|content|contents|url|link|post|entry|record|category|topic|thread|section|service|server|domain|app|application|feature|account|listing|object|view|title|request|location)"
_GONE = (
    r"(?:(?:could not|cannot|can't|couldn't|can not) be (?:found|located|displayed|loaded|reached|opened|shown)|(?:was|were|is|are) (?:not found|not available|missing|unavailable|gone|deleted|removed|moved|"
    r"no longer (?:available|here|online|active|exists?|supported)|currently (?:unavailable|offline|down)|temporarily (?:unavailable|offline|down)|offline|down|parked|disabled|blocked|restricted|private|under (?:construction|maintenance)|for sale)(?: or .*)?|"
    r"(?:does not|doesn't|do not|no longer) exists?(?: any ?more)?|not found|not available|unavailable|no longer available|(?:has|have) (?:moved|expired|been (?:moved|removed|deleted|disabled|blocked|suspended|denied|restricted))(?: or .*)?|may have (?:moved|been .*)|is taking too long.*|isn't (?:available|working|here).*|can't be reached)"
)
_SCRIPT = r"(?:javascript|java script|js|scripts?|scripting|cookies)"
_SCRIPTS = rf"{_SCRIPT}(?:(?: and | & |/| or ){_SCRIPT})?"
_ON = r"(?:enable|activate|allow|turn on|switch on|unblock|permit|accept|re-enable)"
_REASON = (
    r"(?:(?:page |file |document |resource |object |url |item )?not found|forbidden|access (?:denied|forbidden)|unauthori[sz]ed|authori[sz]ation required|bad request|gone|permanently removed|too many requests|internal server error|server error|"
    r"bad gateway|service (?:temporarily )?unavailable|temporarily unavailable|gateway time-?out|request time-?out|time-?out|method not allowed|"
    r"unavailable for legal reasons|not implemented|invalid (?:request|url)|origin (?:is unreachable|dns error|error)|web server is (?:down|returning an unknown error)|connection (?:timed out|refused|reset)(?: by peer)?|"
    r"upstream (?:closed early|timed out|refused the connection|.{1,40})|no healthy upstream|page (?:unavailable|missing|gone))"
)
_NOUN_DE = r"(?:seite|artikel|produkt|datei|dokument|inhalt|adresse|eintrag|thema|beitrag|ressource|website|webseite|shop)"
_NOUN_ES = r"(?:página|pagina|ficha|artículo|producto|archivo|documento|recurso|contenido|dirección|entrada|sitio|enlace|servicio|tienda|tema)"
_NOUN_FR = r"(?:page|adresse|article|fiche|produit|fichier|document|ressource|contenu|site|boutique|lien|sujet|service)"
_NOUN_RU = r"(?:страница|файл|товар|документ|запись|статья|адрес|ресурс|раздел|сайт|тема|карточка)"
_NOUN_PL = r"(?:strona|strony|pliku|produktu|artykułu|dokumentu|plik|produkt|artykuł|dokument|zasób|zasobu|adresu|adres|wpisu|wpis|treści)"
_VAR = r"(?:[\w.\-]*(?:title|titel|titre|titulo|name|heading|headline|header|meta|page|post|product|item|site|brand|category|descri|subject|label|caption|author|keyword|slug|content|text|topic|term|query|value|var|placeholder)[\w.\-]*)"
_FIELD = r"(?:(?:the|page|post|product|item|site|meta|article|company|brand|category|shop|store|entry|document|customer|your|seo|main|section|user|first|last|blog)[ _.\-]?)*(?:title|name|heading|headline|header|subject|caption|label|slug|placeholder|description|text|content)(?:[ _.]?(?:here|goes here|tag|\d))?"

EVIDENCE = {
    "error": [
        rf"(?:http(?:/\d(?:\.\d)?)? )?(?:status|error|code|fehler|erreur|ошибка|błąd|エラー)?(?: code| status)? ?{_CODE}(?: error| fehler)?(?:(?: ?[-–—:|,] ?| ){_REASON})?",
        rf"(?:http )?(?:error|status) {_CODE} ?[-–—:|]? ?.{{0,60}}",
        rf"{_REASON}(?: \(?(?:error )?{_CODE}\)?)?(?: error)?",
        rf"(?:error|fehler|erreur|ошибка|błąd|エラー) ?{_CODE} ?[-–—:|]? ?.{{0,60}}",
        r"(?:oops|hmm+|uh[- ]oh|oh no|sorry|whoops|ouch|yikes|d'oh|argh|ups|huch|hoppla|hups)(?:[,!.: …]+)(?=.*(?:wrong|can't|cannot|could not|couldn't|did not|didn't|does not|doesn't|no longer|not found|not available|unavailable|error|missing|lost|broken|exist|problem|failed|unable|snag|trouble|schiefgelaufen|fehler|nicht|went|mal)).*",
        rf"(?:sorry, ?)?(?:the|this|that|your|our) {_THING}(?: (?:you|that you|you're|you are|you were) .{{0,40}}?)? {_GONE}",
        rf"(?:we|you) (?:could not|couldn't|cannot|can't|were unable to|are unable to) (?:find|load|open|show|display|locate|reach|process|complete) .*",
        r"(?:something|things) went wrong.*|that did(?:n't| not) work|we hit a snag|nothing (?:was )?found(?: here)?|no results found|page (?:missing|unavailable|error|expired|deleted)|no such (?:file|document|item|page|resource|product|record).*",
        r"(?:an?|unexpected|unknown|unhandled|fatal|internal|critical|general|system)(?: \w+)? (?:error|exception|problem)(?: (?:has )?(?:occurred|happened).*| in .{1,40}|: .*)?",
        r"(?:application|runtime|template|parse|parser|database|server|internal|client|script|syntax|connection|network|proxy|php|sql|mysql|render|rendering|system|type|reference|value|key|attribute|import|io|socket|dns|ssl|tls|memory|compile|query|config|configuration|load|loading|fetch|request|validation|security|token|session|cache|disk|plugin|theme) ?(?:error|exception)(?:: .*| - .*| (?:has )?occurred.*| establishing .*)?",
        r"(?:error|exception|warning|fatal|notice|failure)(?: \d+)?: (?:no such|out of|unexpected|call to|undefined|cannot|can't|could not|couldn't|failed|unable|time-?out|timed out|null|invalid|page not|not found|too many|internal|access|permission|missing|unknown|connection|division by|stack|segmentation|maximum).*",
        r"(?:error|exception|unhandled exception|uncaught exception|failure) in (?:the )?(?:main|view|template|render|worker|request|page|module|script|plugin|database|server|background|event)(?: [\w ]{1,30})?",
        r"(?:unhandled|uncaught) (?:exception|error|rejection|\w+error).*|stack trace(?:: .*)?|traceback \(most recent call last\).*|segmentation fault(?: \(core dumped\))?.{0,3}|kernel panic(?:[:,] .*)?",
        r"(?:unhandled |uncaught |fatal )?(?:exception|error|warning) in (?:[\w./\\\\-]+\.\w{1,8}|[\w.:>-]+\(.{0,40}\))(?:,? (?:on |at )?(?:line )?:?\d+)?.{0,20}|(?:error|problem|failure|trouble) (?:while |when )?(?:establishing|connecting|loading|processing|reading|opening|parsing|rendering|fetching|retrieving|executing|compiling|resolving) (?:to )?(?:a|an|the|your|this|page|template|data|file|view|request|content|resource)\b.*",
        r"(?:malformed|invalid|bad|illegal|unsupported|unknown|missing) (?:request|parameter|parameters|url|uri|query|argument|arguments|token|id|identifier|page|path|header|host|session|link)",
        rf"this site can't be reached|this page isn't working|(?:the )?connection (?:has )?timed out|(?:server|host|domain) not found|unable to connect|no internet(?: connection)?|err_[a-z_]+|dns_probe_[a-z_]+|request (?:failed|timed out|aborted|blocked)|(?:your )?(?:session|link|token) (?:has )?(?:timed out|expired)(?:[,;.:] .*)?",
        # German, French, Spanish, Russian, Polish, Japanese
        rf"(?:die |diese |dieser |dieses |der |das )?{_NOUN_DE} (?:wurde |konnte |ist |existiert )?(?:leider )?(?:nicht|nicht mehr|derzeit nicht|vorübergehend nicht) ?(?:gefunden|verfügbar|vorhanden|erreichbar|mehr verfügbar|mehr vorhanden)?(?: werden)?",
        r"interner (?:server)?fehler|(?:internal )?server-?fehler|datenbankfehler|anwendungsfehler|(?:ein )?(?:unerwarteter )?fehler (?:ist )?(?:aufgetreten|bei der verarbeitung.*)|(?:es ist )?(?:leider )?(?:ein|etwas) (?:fehler aufgetreten|ist schiefgelaufen)|etwas ist schief ?gelaufen|ungültige anfrage|zeitüberschreitung.*|dienst (?:derzeit )?nicht verfügbar|sitzung abgelaufen.*",
        rf"(?:la |el |esta |este )?{_NOUN_ES} no (?:encontrad[oa]|disponible|existe|está disponible|se encuentra)(?: .*)?|no se (?:ha )?(?:encontr|pudo ).*|no encontrad[oa]",
        r"error interno(?: del servidor)?|error del servidor|error de (?:la )?(?:base de datos|aplicación|conexión)|(?:se ha producido|ha ocurrido|ocurrió) un error.*|algo (?:ha salido|salió|fue) mal.*|solicitud (?:incorrecta|no válida)|servicio (?:temporalmente )?no disponible|sesión (?:caducada|expirada).*|tiempo de espera agotado",
        rf"{_NOUN_FR} (?:introuvable|non trouvée?|indisponible|inexistante?|supprimée?|momentanément indisponible|temporairement indisponible)|(?:cette|cet|ce|la|le|l') ?{_NOUN_FR} (?:n'existe (?:plus|pas)|est introuvable|n'est (?:plus|pas) disponible|a été (?:supprimée?|déplacée?)|demandée?.*)|(?:nous n'avons|on n'a) pas trouvé.*",
        r"erreur(?: interne)?(?: du)? serveur|erreur interne(?: .*)?|erreur de (?:base de données|connexion|l'application)|(?:une )?erreur (?:est survenue|s'est produite|inattendue).*|quelque chose s'est mal passé.*|requête (?:invalide|incorrecte)|service (?:momentanément |temporairement )?indisponible|session expirée.*|délai (?:d'attente )?dépassé",
        rf"(?:эта |этот |запрашиваемая |запрошенная )?{_NOUN_RU} (?:не найден[аоы]?|не существует|больше не существует|удален[аоы]?|удалён|недоступ(?:на|ен|но))|ничего не найдено|не найдено",
        r"(?:внутренняя )?ошибка (?:сервера|базы данных|приложения|соединения|подключения)|(?:произошла|возникла) (?:непредвиденная )?ошибка.*|что-то пошло не так.*|неверный запрос|(?:сервис|сервер|сайт) (?:временно )?недоступен|сессия истекла.*|время ожидания истекло",
        rf"nie znaleziono(?: {_NOUN_PL})?|{_NOUN_PL} (?:nie istnieje|nie została? znalezion[aey]|niedostępn[aey]|już nie istnieje|została? usunięt[aey])|(?:ta )?{_NOUN_PL} (?:jest )?(?:obecnie |tymczasowo )?niedostępn[aey]",
        r"(?:wewnętrzny )?błąd (?:serwera|bazy danych|aplikacji|połączenia)|(?:wystąpił|wystąpiły) (?:nieoczekiwany |nieznany )?błąd.*|coś poszło nie tak.*|nieprawidłowe żądanie|usługa (?:jest )?(?:chwilowo |tymczasowo )?niedostępna|sesja wygasła.*",
        r"(?:お探しの)?(?:ページ|記事|商品|ファイル|ドキュメント|コンテンツ|リンク)(?:が|は)(?:見つかりません|見つかりませんでした|存在しません|ありません|削除されました|表示できません|利用できません)(?:でした)?.*|(?:サーバー|内部|データベース|システム)?(?:内部)?エラー(?:が発生(?:しました|しています)?.{0,20})?(?: ?\d{3})?|問題が発生しました.{0,20}|サービス(?:は|が)?(?:一時的に)?(?:利用できません|ご利用いただけません).*",
    ],
    "access": [
        r"access (?:is |was )?(?:denied|forbidden|restricted|blocked)(?: \(?(?:error )?\d{3}\)?|[.!:,] .*)?|access to this (?:page|site|resource|website|content) (?:has been|is|was) (?:denied|blocked|restricted|forbidden)|permission denied|not authori[sz]ed|you (?:do not|don't|are not|aren't|have no|need) (?:have )?(?:permission|access|authori[sz]ed|allowed)(?: .*)?|you(?:'ve| have) been (?:blocked|denied|banned|rate limited)(?: .*)?|(?:sorry, )?you have been blocked",
        r"your (?:ip|ip address|connection|account|network|request|access|device)(?: address)? (?:has been|is|was) (?:temporarily |permanently )?(?:blocked|rate limited|rate-limited|banned|denied|throttled|suspended|flagged|restricted)(?: .*)?|rate limit(?: exceeded| reached)|too many (?:requests|attempts|logins)(?: .*)?",
        r"acceso (?:denegado|restringido|prohibido|no autorizado)|accès (?:refusé|interdit|restreint|non autorisé)|zugriff (?:verweigert|nicht erlaubt|gesperrt)|zugang (?:verweigert|gesperrt)|keine berechtigung|доступ (?:запрещ[её]н|ограничен|закрыт|заблокирован)|(?:brak|odmowa) dostępu|dostęp (?:zabroniony|zablokowany)|アクセス(?:が|は)?(?:拒否|禁止|制限)(?:されました|されています)?.*|アクセス権がありません.*|閲覧権限がありません.*",
        r"(?:please |you must |you need to |you have to )?(?:log|sign) ?in(?:(?: or|,) (?:register|sign ?up|join|create an account))?(?: first)? (?:to|before) (?:continue|see|view|access|read|proceed|use|open|reach|continuing|viewing).*|(?:please )?(?:log|sign) ?in(?: again| required| page| first)?|login(?: required| page| to .*)?|(?:please )?log in(?:[,:] .*)?|authentication required|members? only(?: (?:area|content))?|members? area|subscribers? only|registration required|(?:please )?(?:register|sign up|create an account) to (?:continue|view|see|read|access).*|you (?:must|need to|have to) be (?:logged|signed) in.*|this (?:content|page) is (?:for|only for) (?:members|subscribers).*|subscribe to (?:continue|read|keep reading).*",
        r"(?:bitte )?(?:anmelden|einloggen|melden sie sich an|loggen sie sich ein)(?:,? .*)?|anmeldung erforderlich|(?:bitte )?melde dich an.*|(?:por favor, ?)?(?:inicie|inicia|iniciar) sesión(?: .*)?|(?:veuillez )?(?:vous connecter|connectez-vous)(?: .*)?|connexion (?:requise|nécessaire)|(?:пожалуйста, ?)?(?:войдите|авторизуйтесь|требуется авторизация|необходима авторизация)(?:,? .*)?|(?:zaloguj się|wymagane logowanie|musisz się zalogować)(?:,? .*)?|ログイン(?:してください|が必要です|が必要).*",
    ],
    "check": [
        r"(?:we are |we're )?(?:checking|verifying|validating|inspecting) (?:(?:if|that|whether) (?:the (?:site|connection)|your? ).*|you(?:r (?:browser|connection|identity|device|request|network|access|session|humanity|age|ip)| are| )\b.*|the (?:site |security of (?:the|your) )?(?:connection|browser)(?: .*)?)|(?:are you|prove you are|prove you're|you are|confirm you are|confirm you're) (?:a |an |not a |not an |really )?(?:robot|human|bot|person)(?: .*)?|i(?:'m| am) not a robot|(?:please )?(?:confirm|verify|prove|show)(?: to us)?(?: that)? (?:you|you're|you are) (?:are )?(?:not a |not an |a |really a |indeed )?(?:bot|robot|human|person|real)(?: .*)?|(?:please )?(?:verify|confirm) (?:your|that) (?:humanity|identity|browser|connection|age).*|(?:human|bot|robot|browser|security|identity|age|captcha|connection|anti-bot) (?:verification|check|challenge)(?: (?:required|in progress|failed|needed))?",
        r"(?:one|just one) more step(?:[:,.… \-–]+(?:(?:please|to) .*|(?:complete|solve|verify|confirm|prove|pass|enter|finish) .*|captcha.*))?|(?:please )?(?:complete|solve|enter|fill in) (?:the|this|a) (?:captcha|challenge|security check).*|captcha(?: required| challenge| check)?|attention required(?:!? ?[|–-] ?.{0,30})?|ddos protection.*|(?:just |please wait )?(?:a|one) moment(?:,? please)?|just a (?:moment|second|minute)|please (?:wait|hold on|stand by).*|(?:wait|hold on)(?: (?:a|one) (?:moment|second|minute))?|pardon (?:our|the) interruption|(?:you are|you're|you will be|you're being) (?:now )?(?:being )?redirected.*|redirecting(?: .{0,30})?|(?:please )?click here if (?:you are|you're|your browser|the page|nothing).*|(?:(?:page|content|site|data) (?:is )?)?loading(?: (?:page|content|data|the page|site|your .{1,20}|please wait|in progress))?|(?:please )?stand by|under attack mode|performance & security by .*|suspicious (?:activity|traffic)(?: detected)?|unusual (?:activity|traffic).*",
        r"(?:bitte )?(?:einen|ein) (?:moment|augenblick)(?:,? bitte)?|bitte warten.*|sie werden (?:weitergeleitet|umgeleitet).*|weiterleitung(?: (?:läuft|erfolgt))?|sie werden umgeleitet|(?:wird|seite wird) geladen|(?:ihr|dein|der) browser wird (?:über|ge)prüft.*|sicherheits(?:über)?prüfung|sind sie ein (?:mensch|roboter)|un momento(?:,? por favor)?|espere(?: .*)?|por favor,? espere.*|cargando|redirigiendo.*|(?:verificando|comprobando) (?:su|tu|el|la) .*|¿?(?:es|eres) (?:usted )?(?:un )?(?:robot|humano)\??|verificación (?:humana|de seguridad)|(?:un instant|un moment|veuillez patienter|patientez)(?:,? .*)?|chargement(?: en cours)?|redirection(?: en cours)?|vérification (?:de sécurité|en cours|humaine|(?:de votre|du) navigateur|de votre connexion)(?: .*)?|êtes-vous un (?:robot|humain)|подождите(?:,? .*)?|(?:одну|один|одна) (?:минуту|минутку|момент|секунду)(?:,? .*)?|(?:идёт |идет )?загрузка|перенаправление.*|проверка (?:браузера|безопасности|соединения|вашего .*)|вы (?:не )?робот|(?:proszę )?(?:czekać|czekaj)(?: .*)?|(?:proszę )?(?:chwileczkę|chwilę|chwila)(?:,? proszę.*|,? (?:czekać|trwa|ładowanie).*)?|(?:trwa )?(?:ładowanie|przekierowanie|przekierowywanie)|(?:sprawdzanie|weryfikacja) (?:twojej |twojego |)(?:przeglądarki|połączenia|człowieka|captcha)(?: .{0,20})?|czy jesteś (?:robotem|człowiekiem)|(?:少々|しばらく)?お待ちください.*|読み込み中.*|リダイレクト(?:しています|中).*|ブラウザを?(?:確認|チェック).*|セキュリティ(?:チェック|確認).*|あなたはロボットですか.*|ロボットではありません.*",
        r"(?:this|your|the) (?:browser|web browser|device)(?: version)? (?:is|isn't|has|does not|doesn't|no longer|not)(?: (?:not|no longer|being|out|too|unsupported|outdated|supported|support|old|longer|of|date|block(?:ed|ing)?))+.*|(?:unsupported|outdated|old|incompatible) browser(?: (?:detected|version))?|browser (?:not|no longer|is not) supported|(?:please )?(?:update|upgrade) your browser(?: .*)?|(?:ihr|dein|dieser) browser (?:wird|ist) (?:nicht|leider nicht|nicht mehr|veraltet).*|browser (?:nicht unterstützt|veraltet)|(?:su|tu|este) navegador no (?:es compatible|está soportado|es compatible.*)|navegador no compatible|(?:votre|ce) navigateur n'est (?:pas|plus) .*|navigateur non (?:pris en charge|supporté)|(?:ваш|этот) браузер (?:не поддерживается|устарел).*|браузер не поддерживается|(?:twoja|ta) przeglądarka (?:nie jest|jest) .*|przeglądarka nieobsługiwana|(?:お使いの|この)?ブラウザ(?:は|ー は|ーは)?(?:サポート|対応)(?:されて)?(?:いません|していません).*",
    ],
    "script": [
        rf"(?:please |you need to |you must |you have to |you will need to |to continue,? (?:please )?|kindly ){_ON} (?:support for )?{_SCRIPTS}(?: support)?(?:,? .*)?",
        rf"{_ON} {_SCRIPTS}(?: support)?(?:(?: in| for| on| to| and)(?: your| this| the| our| continue| view| run| use| see| proceed| reload| access| load| refresh)\b(?:(?! editor).)*)?",
        rf"(?:this|our|the) (?:[\w-]+ )?(?:page|site|website|shop|store|app|application|forum|content|service|wiki|portal|tool|feature|web app|form|document|view|area|section) (?:needs|requires|relies on|uses|depends on|works only with|only works with|will not work without|does not work without|doesn't work without|cannot work without) (?:{_SCRIPTS}|(?:cookies|javascript) to be enabled|you to {_ON} .*)(?: .*)?",
        rf"{_SCRIPTS}(?: support)? (?:is|are|must be|has to be|have to be|should be|needs to be|need to be|appears to be|seems to be|was|were|is currently)(?: currently| not| turned| switched)* ?(?:enabled|disabled|required|needed|off|on|blocked|activated|allowed|available|deactivated|necessary|supported|missing)(?: .*)?|{_SCRIPTS} (?:disabled|required|needed|blocked|off|not (?:enabled|available|supported|detected))(?: .*)?|no {_SCRIPTS}(?: (?:detected|support|available))?|(?:we've detected|it looks like|it seems)(?: that)? (?:that )?{_SCRIPTS} .*|(?:your browser|your device) (?:does not support|doesn't support|has disabled|has|blocks|is blocking) {_SCRIPTS}.*|requires {_SCRIPTS}",
        r"(?:por favor,? )?(?:active|activa|habilite|habilita|permita|permite|active usted|debe (?:activar|habilitar|permitir)|es necesario (?:activar|habilitar)|se requiere) (?:el |los |las )?(?:javascript|scripts?|cookies)(?: y (?:javascript|las cookies|cookies))?(?: .*)?|javascript (?:está |es )?(?:desactivado|deshabilitado|necesario|requerido|obligatorio)(?: .*)?|(?:esta|este) (?:página|sitio|tienda|aplicación) (?:necesita|requiere) (?:javascript|cookies).*",
        r"(?:veuillez |merci d'|vous devez |il faut )?(?:activer|activez|autoriser|autorisez|permettre) (?:le |les )?(?:javascript|scripts?|cookies)(?: et (?:javascript|les cookies))?(?: .*)?|(?:le )?javascript (?:est )?(?:désactivé|requis|nécessaire|obligatoire)(?: .*)?|(?:cette|ce) (?:page|site|boutique|application) (?:nécessite|requiert|a besoin de) (?:le )?javascript.*",
        r"(?:bitte |sie müssen |du musst )?(?:javascript|skripte|scripts|cookies)(?: und (?:javascript|cookies|skripte))? (?:im browser |in ihrem browser )?(?:aktivieren|zulassen|erlauben|einschalten|freigeben|wird benötigt|ist erforderlich|ist deaktiviert|ist ausgeschaltet|erforderlich|deaktiviert)(?:,? .*)?|(?:bitte )?(?:aktivieren|erlauben|aktiviere|erlaube) sie? ?(?:javascript|skripte|cookies).*|(?:diese|dieser) (?:seite|shop|website|anwendung) (?:benötigt|erfordert|braucht) (?:javascript|skripte|cookies).*",
        r"(?:пожалуйста,? )?(?:включите|разрешите|активируйте|необходимо включить|требуется|нужно включить|нужен) (?:поддержку )?(?:javascript|скрипты|cookies?|куки)(?:,? .*)?|javascript (?:отключ[её]н|выключен|не включ[её]н|обязателен|требуется)(?: .*)?|(?:для работы|эта страница|этот сайт|сайт) .{0,30}(?:требует|требуется|нужен|необходим) ?(?:javascript|скрипты).*",
        r"(?:proszę )?(?:włącz|włączyć|włączcie|zezwól na|odblokuj|aktywuj|musisz włączyć|wymagany jest|wymagana jest) (?:obsługę |obsługa )?(?:javascript|javascriptu|skrypty|skryptów|ciasteczka|cookies)(?: .*)?|javascript (?:jest )?(?:wyłączony|wymagany|zablokowany)(?: .*)?|(?:ta|ten) (?:strona|witryna|sklep|aplikacja) wymaga (?:javascript|javascriptu|skryptów).*",
        r"(?:このサイト|このページ|当サイト|続行する)?.{0,12}?(?:javascript|スクリプト|クッキー|cookie)(?:を|が|の)?(?:有効|オン|許可|必要|無効|オフ).*",
    ],
    "maintenance": [
        r"(?:site |page |website |shop |this (?:site|page) is )?(?:currently )?under (?:construction|maintenance|development)|(?:launching |opening )?coming soon|(?:we(?:'ll| will| are|'re)? )?(?:be |coming |will be )?(?:right )?back (?:soon|shortly|later|online|in a .{1,20}|in \d+ .{1,20}|at \d.{0,10}|within .{1,20}|again .{0,20})?(?:soon|shortly)?(?: ?[-–—:,] ?(?:scheduled|planned|routine|site|system|emergency|server)? ?(?:maintenance|update|upgrade)(?: .{0,30})?)?|(?:we are |we're |site |website |currently |temporarily )*(?:down|closed|offline)(?: for)? ?(?:scheduled|planned|routine|emergency)? ?(?:maintenance|repairs|updates?)?|(?:scheduled|planned|routine|emergency|site|system|server|website|ongoing) maintenance(?: (?:in progress|underway|window|break|mode))?|maintenance (?:mode|in progress|underway|break)(?: (?:on|enabled))?|(?:temporarily|currently) (?:unavailable|offline|closed|down)(?: .{0,30})?|service (?:is )?(?:temporarily |currently )?(?:unavailable|suspended|interrupted)(?: .{0,20})?|this (?:domain|domain name|site|page|account) (?:is|has been) (?:parked|for sale|suspended|expired|coming soon|under construction|reserved)(?: .*)?|(?:parked|expired) domain|domain (?:parked|expired|for sale|parking)|account suspended|future home of .*|(?:website|site|page) (?:is )?coming soon|(?:site|shop|store) (?:opening|launching) soon",
        r"wartungsarbeiten(?: .*)?|wartungsmodus|geplante wartung(?: .{0,40})?|wartung(?: (?:läuft|im gange|aktiv))?|(?:wegen|aufgrund) (?:von )?wartung.*|(?:wir sind )?(?:gleich|bald) (?:wieder )?(?:zurück|da|für sie da|online)|im aufbau|(?:diese )?(?:seite|website|baustelle)(?: ist)? (?:im aufbau|in bearbeitung|wird überarbeitet)|demnächst(?: (?:hier|mehr|verfügbar|online))?|(?:en|sitio en|página en|web en) (?:mantenimiento|construcción)|mantenimiento (?:programado|en curso)|(?:volvemos|volveremos|regresamos) (?:pronto|enseguida|en .*)|próximamente|(?:en|site en|page en|boutique en) (?:maintenance|construction|travaux)|maintenance (?:en cours|programmée|planifiée)|(?:nous revenons|de retour|bientôt de retour)(?: .{0,20})?|bientôt (?:disponible|en ligne)|(?:ведутся |идут )?(?:технические|профилактические|плановые) работы(?: .*)?|техническое обслуживание|сайт (?:в разработке|на реконструкции|на обслуживании|на техобслуживании|закрыт на .*|временно .*)|(?:страница|раздел) в разработке|скоро (?:открытие|вернёмся|вернемся|будет)|(?:przerwa|prace|przerwy) (?:techniczn[aey]|konserwacyjn[aey]|serwisow[aey])(?: .*)?|(?:strona|witryna|sklep) w (?:budowie|przebudowie|konserwacji|przygotowaniu)|(?:zaraz|wkrótce) wracamy|już wkrótce|(?:ただいま|現在)?(?:システム)?メンテナンス(?:中.{0,20}|のお知らせ.{0,20})?|(?:工事|準備|作成|構築)中.*|近日公開.*|まもなく.{0,10}",
    ],
    "filler": [
        r"lorem ipsum(?: dolor(?: sit(?: amet.*)?)?)?|dolor sit amet.*|consectetu?r adipisc?ing elit.*|sed do eiusmod tempor.*|incididunt ut labore.*|ut enim ad minim.*|quis nostrud exercitation.*|duis aute irure.*|excepteur sint.*|neque porro quisquam.*|at vero eos et.*|nemo enim ipsam.*|cupidatat non proident.*|curabitur .{0,30}(?:amet|elit|nec).*|vestibulum .{0,30}(?:amet|elit|nec).*|li europan lingues.*|the quick brown fox(?: jumps over the lazy dog)?",
        r"(?:this is )?(?:some |a |an )?(?:dummy|sample|placeholder|example|filler|test|demo|default|temporary|temp|blind) ?(?:text|title|page|post|content|heading|headline|entry|article|product|item|document|copy|caption|name|data)?s?(?: (?:goes|go|comes) here| here)?(?:,? (?:please )?(?:ignore|do not (?:use|publish)|delete)(?: .*)?)?|(?:text|content|copy|headline|heading|title|name) (?:goes|comes|to go|to come|tbd|tba) ?(?:here)?|(?:asdf|qwerty|qwertz|asdasd|asd|jkl|foo|bar|baz|blah|bla|test|testing|xxx+|zzz+|aaa+|abc|123|1234)(?:[ _\-,]*(?:asdf|qwerty|qwertz|asdasd|asd|jkl|foo|bar|baz|blah|bla|test|testing|xxx+|zzz+|aaa+|abc|123|1234|title))*|xxx+ .{0,20} xxx+|(?:todo|fixme|tbd|tba|wip|tk|tktk)(?:: ?.{0,40})?|test(?:ing)?(?: (?:page|post|title|product|entry|article))?(?: \d+)?(?:[,\- ]+please ignore)?|ignore (?:this|me)|please ignore|delete (?:this|me)",
        r"hello,? world|just another (?:\w+ )?(?:site|weblog|blog|website|shop|page)|my (?:new |first |awesome )?(?:site|website|blog|page|shop|store|web page|wordpress site|post)|your (?:site|website|blog|page|shop|store|company|business)(?: (?:name|title|tagline|here))*|(?:welcome to )?(?:nginx|apache2?(?: .{0,20})? default page|iis windows server)|it works|index of /.*|test page for (?:the )?(?:apache|nginx|http|iis|web server).*|default (?:web ?site|web ?)page.*|site (?:title|name)|blog (?:title|name)|another page|your tagline here|tagline goes here",
        r"(?:texto|título) de (?:ejemplo|prueba|relleno|muestra)|página de (?:ejemplo|prueba|muestra)|entrada de (?:ejemplo|prueba)|texte de (?:remplacement|démonstration|test|remplissage|substitution)|(?:faux texte|texte d'exemple|exemple de texte|page d'exemple|exemple de page|page de test|titre d'exemple|texte bidon)|(?:beispiel|muster|test|platzhalter|blind|dummy)-?(?:seite|text|titel|beitrag|eintrag|artikel|überschrift)?|hier steht (?:ein )?(?:text|titel|ihr .*)|(?:пример|образец) (?:текста|страницы|заголовка|записи)|(?:тестовая|тестовый|пробная) (?:страница|текст|запись|заголовок)|(?:рыба-текст|рыба|текст-заполнитель|текст-рыба|заглушка)|привет,? мир|(?:przykładow[aey]|testow[aey]) (?:strona|tekst|wpis|tytuł|treść)|tekst (?:zastępczy|przykładowy|testowy)|witaj,? świecie|(?:サンプル|テスト|ダミー|見本|プレースホルダー)(?:ページ|テキスト|投稿|タイトル|記事)?.{0,4}|hallo,? welt|¡?hola,? mundo|bonjour(?: tout le monde|,? le monde)",
    ],
    "default": [
        r"(?:untitled|unnamed|no title|no name|no subject|without title)(?:[- _]?\d+|[- ](?:document|page|post|product|entry|file|item|article|draft|note|project)(?:[- ]?\(?\d+\)?)?)?|(?:new|blank|empty|default)(?: (?:page|document|post|product|entry|item|article|tab|title|site|file|record|folder|note))(?: ?\(?\d+\)?)?|(?:page|post|product|item|article|document|entry|site|section|seo|meta|main|sub) ?(?:title|name|heading|headline)(?: (?:here|goes here|\d+))?|title(?: (?:here|goes here|missing|\d+|tag|text))?|(?:document|page|slide|item|product|article|post)[ _-]?\d{1,3}|(?:headline|heading|subject|subtitle)(?: (?:here|goes here|\d+))?|(?:<?)(?:please )?(?:insert|enter|add|type|your|set|edit|write|put|change|choose|provide|replace)(?: (?:your|a|the|page|post|product|site|article|this|meta|seo|item|company|brand|main|own))* (?:title|headline|name|heading|text|content|header|caption|subject|tagline)(?: (?:here|text|now|in here))?(?:>?)|(?:title|name|text|headline|heading|site|page|content|description)? ?\(?(?:please )?(?:change|edit|replace|rename|fill|update|remove) (?:me|this|in|here|title|later|before publishing)\)?|missing title|title (?:not set|missing|unavailable)|no page title|home ?page title|todo",
        r"(?:null|undefined|nan|none|nil|void|n/?a|false|true|empty|unknown|object|\(null\)|\(none\)|\(undefined\)|\(unbekannt\)|\(no title\)|<no title>|\(untitled\)|\(empty\)|\[object object\]|\[object \w+\]|\[native code\]|%s|%d|%@|\?{2,}|-{1,3}|_+|\.{2,}|#n/a|#ref!|#value!|#name\??)(?:(?: ?[-–—|:,/] ?| )(?:null|undefined|nan|none|nil|n/?a|\[object object\]|%s|%d|%@))*",
        r"(?:sans titre|sin título|sin titulo|ohne titel|senza titolo|sem título|bez tytułu|bez nazwy|без названия|без имени|без заголовка|無題|名称未設定|タイトルなし|unbenannt|unbenannte[srn]?|unbetitelt)(?:[ -]?(?:\d+|dokument|seite|document|page|página|documento|документ|страница|dokument|strona|ドキュメント|ページ|のドキュメント|のページ|projekt|datei|artikel))?(?: ?\d+)?|titre de (?:la page|l'article|la fiche|la|votre page)|(?:título|titulo) de (?:la página|la pagina|página|el artículo|la ficha|la entrada)|(?:seiten|artikel|produkt|beitrags)titel(?: .{0,25})?|(?:titel|überschrift|name|text|seitentitel)(?: (?:der seite|des artikels))? (?:hier )?(?:einfügen|eingeben|eintragen|hier|fehlt|ergänzen)|hier (?:titel|text|überschrift) (?:einfügen|eingeben)|(?:insérer|insérez|saisir|saisissez|entrer|entrez|ajouter|ajoutez)(?: (?:le|un|votre|ici le))? (?:titre|texte|nom)(?: .{0,15})?|(?:titre|texte) (?:ici|à remplacer|à compléter|par défaut)|(?:inserte|insertar|introduzca|escriba|añada|inserta|añadir|escribe)(?: (?:el|un|su|tu|aquí el|aquí su))? (?:título|texto|nombre)(?: .{0,15})?|(?:título|texto) (?:aquí|por defecto|predeterminado)|(?:новая|пустая) (?:страница|запись|статья)(?: \d+)?|новый документ(?: \d+)?|(?:заголовок|название) (?:страницы|статьи|записи|документа|здесь)|(?:введите|вставьте|добавьте|укажите) (?:сюда )?(?:заголовок|название|текст)(?: .{0,15})?|(?:nowa|pusta) strona(?: \d+)?|nowy dokument(?: \d+)?|(?:tytuł|nazwa) (?:strony|artykułu|wpisu|tutaj|produktu)|(?:wpisz|wstaw|dodaj|podaj|wprowadź) (?:tutaj |tu )?(?:tytuł|nazwę|tekst)(?: .{0,15})?|(?:neue|leere|unbenannte) seite(?: \d+)?|neues dokument(?: \d+)?|(?:nueva|página) (?:página|en blanco|nueva)(?: \d+)?|nuevo documento(?: \d+)?|(?:nouvelle|page) (?:page|vierge|blanche|sans titre)(?: \d+)?|nouveau document(?: \d+)?|(?:新しい|新規)(?:ページ|ドキュメント|文書|投稿).{0,4}|(?:ページ(?:の)?|記事(?:の)?|文書の)?タイトル(?:を入力|をここに|未設定|を入れて).{0,10}|ページ(?:の)?タイトル",
    ],
}
#: An unfilled placeholder. The first list holds forms that are template syntax whatever is
#: inside; the second, forms that occur in ordinary titles too and need a field's name inside.
PLACEHOLDERS = [
    r"\{\{\{?[^{}]{0,60}\}?\}\}", r"\{%[^{}]{0,60}%\}", r"<%[=\-#]?[^<>]{0,60}%>", r"<\?(?:php|=)?[^<>]{0,60}\?>", r"\$\{[^{}]{1,60}\}", r"#\{[^{}]{1,60}\}",
    r"%%[\p{L}_.\- ]{2,40}%%", r"@@[\p{L}_.\- ]{2,40}@@", r"\[%[^\[\]]{1,60}%\]", r"\[\[[\w.\- ]{1,60}\]\]", r"##[\p{L}_.]{2,40}##", r"\$\$[\p{L}_.]{2,40}\$\$", r"\$[a-z]+(?:[._][a-z]+)+\$?",
    rf"%{_VAR}%", rf"\{{{_VAR}\}}", rf"__{_VAR}__", rf"\[{_FIELD}\]", rf"<{_FIELD}>", rf"«{_FIELD}»", rf":{_FIELD}:",
    r"\[(?:insert|your|enter|add|type|put|my|company|customer|city|brand|user)[^\[\]]{0,40}\]", r"<(?:insert|your|enter|add|type)[^<>]{0,40}>", r"\{(?:insert|your|enter|add)[^{}]{0,40}\}", r"%[sd@](?=\W|\z)(?: ?[-|:] ?%[sd@])*",
]

# --- Rules on top of the fixed values.
_SEPARATOR = r" +[|\-–—·•»›/] +"
_PH = "(?:" + "|".join(PLACEHOLDERS) + ")"
#: At the start or at the end of a line, or where a greeting names someone; elsewhere in the middle
#: it is part of a sentence about templates.
_GREETING = r"(?:hello|hi|hey|dear|welcome(?: back)?|thanks|thank you|hallo|hola|bonjour|liebe[rs]?|cześć|witaj|привет|здравствуйте)"
_PH_EDGE = rf"(?:^{_PH}(?![\w])|(?<![\w%]){_PH}$|^{_GREETING},? {_PH})"
_WHOLE = r"^[\s¡¿\"'(\[*~_–-]*(?:" + "|".join(p for group in EVIDENCE.values() for p in group) + r")[\s!?.…,;:\"')\]*~_。！？–-]*$"
_DECORATION = r"(?iu)[\s,;\-–|]*\((?:ref(?:erence)?|id|code|ray id|incident|request|case|nr|no|#|event)?[ .:#]*[0-9a-f]{1,40}(?:-[0-9a-f]+)*\)\s*$|[\s,;\-–|]+(?:ref(?:erence)?|ray id|incident id|request id|error id)[ .:#]+[0-9a-f\-]{4,40}\s*$"


def plain_title(title: Column | str) -> Column:
    """Lower case, entities resolved, straight apostrophes, no reference numbers."""
    t = F.lower(squeeze(title))
    # A title may be escaped twice.
    for _ in range(2):
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.translate(t, "’‘`´“”„＿\u00a0", "''''\"\"\"_ ")
    return F.regexp_replace(t, _DECORATION, "")


def is_evidence(line: Column) -> Column:
    """The whole line, or what follows a name of at most two words and a colon, is evidence,
    or an unfilled placeholder stands at an edge of the line. Each pattern runs only on lines
    that hold its marks."""
    after = F.regexp_replace(line, r"^[\p{L}\p{N}.'&-]+(?: [\p{L}\p{N}.'&-]+)?: +", "")
    return line.rlike(_WHOLE) | F.when(line.rlike(r"[{\[<%$#@_«:]"), line.rlike(_PH_EDGE)).otherwise(False) | F.when(F.contains(line, F.lit(": ")), after.rlike(_WHOLE)).otherwise(False)


def host_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?i)^\s*[a-z][a-z0-9+.\-]*://([^/?#:\s]*)", 1))


def _plain_words(c: Column) -> Column:
    """Words of letters and digits, parted by one hyphen each."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "-"), r"^-|-$", "")


def _name(line: Column) -> Column:
    """A line without the word for the kind of site that follows a name."""
    return F.regexp_replace(line, r" (?:shop|store|wiki|hub|blog|forum|docs|help|site|online|inc\.?|ltd\.?|gmbh)$", "")


def line_counts(titles: DataFrame, wanted: DataFrame, name_words: int = NAME_WORDS) -> DataFrame:
    """(host, name, n, n_all): in how many different titles a wanted name stands, on the host and
    on all hosts together. A name stands in a title as one of its lines or as the first
    words of one.

    ``titles`` has host, title and lines; ``wanted`` the distinct (name) to count. Counts are
    exact; different titles are told apart by a partial aggregate, so a line that a
    third of all titles share gathers nowhere.
    """
    starts = lambda l: F.array(*[F.substring_index(l, " ", k) for k in range(1, name_words + 1)])
    each = F.array_distinct(F.flatten(F.transform("lines", lambda l: F.concat(F.array(_name(l)), starts(l)))))
    stands = titles.select("host", "title", F.explode(each).alias("name")).join(wanted, "name", "left_semi")
    by_host = stands.groupBy("host", "name").agg(F.count_distinct(F.xxhash64("title")).alias("n"))
    every = by_host.groupBy("name").agg(F.sum("n").alias("n_all"))
    return by_host.join(every, "name")


def residue_entries(entries: DataFrame, recurrent: int = RECURRENT, name_words: int = NAME_WORDS) -> DataFrame:
    """(entry_id, kind, residual) of entries whose current title is no title.

    ``entries`` has id, url, title and updated_at. The current row is the one with the
    greatest updated_at. Lines that stand beside evidence are counted over all current
    titles by host, with map-side combine, and joined back spread by a salt where one is
    hot. A title counts if only evidence is left once recurrent lines, the host's own
    names and the name in the address are subtracted. A null, empty or blank title is
    missing, not residue, and is no case; very long titles are judged whole. Empty tables
    give no rows.
    """
    work = Workspace(entries.sparkSession, "residue")
    now = spread(current_rows(entries, columns=["url", "title"])).select("id", "url", host_of("url").alias("host"), plain_title("title").alias("title")).where(F.col("title") != "")
    lines = F.filter(F.split("title", _SEPARATOR), lambda s: F.trim(s) != "")
    # Read twice, and a filter over patterns must not be pushed below the work on titles.
    cut = work.write(now.withColumn("lines", F.transform(lines, lambda s: F.trim(s))), "titles")
    # The patterns run once over each title and, where it has several, over each line. What
    # holds any evidence is a small part; written, it is not worked out again.
    marks = F.when(F.size("lines") > 1, F.transform("lines", is_evidence)).otherwise(F.array().cast("array<boolean>"))
    marked = cut.withColumn("whole", is_evidence(F.col("title"))).withColumn("marks", marks)
    marked = work.write(marked.where(F.col("whole") | F.exists("marks", lambda m: m)), "marked")
    sure = marked.where(F.col("whole")).select("id", F.col("title").alias("residual"))
    rest = marked.where(~F.col("whole"))
    parts = rest.select("id", "url", "host", F.posexplode(F.arrays_zip(F.col("lines").alias("line"), F.col("marks").alias("mark"))).alias("pos", "p")).select(
        "id", "url", "host", "pos", "p.line", "p.mark", _name(F.col("p.line")).alias("name")
    )
    # Evidence recurs, too, and is never subtracted.
    wanted = parts.where(~F.col("mark")).select("name").distinct()
    counts = work.write(line_counts(cut, wanted, name_words), "counts")
    judged = lookup(parts, counts, ["host", "name"], "left", spread="id")
    label = F.regexp_extract("host", r"([^.]+)\.[^.]+$", 1)
    own = (F.col("line") == F.col("host")) | (F.col("name") == label)
    # The last part of the address, with a tail of its own, names the page.
    slug = _plain_words(F.lower(F.regexp_extract("url", r"([^/?#]+)/*(?:[?#].*)?$", 1)))
    named = F.startswith(F.concat(slug, F.lit("-")), F.concat(_plain_words(F.col("line")), F.lit("-"))) & (_plain_words(F.col("line")) != "")
    name = (F.col("n") >= recurrent) | (F.col("n_all") >= recurrent) | own | named
    kept = judged.groupBy("id").agg(
        F.min(F.col("mark") | F.coalesce(name, F.lit(False))).alias("only"),
        F.array_sort(F.collect_list(F.when(F.col("mark"), F.struct("pos", "line")))).alias("left"),
    )
    partial = kept.where(F.col("only")).select("id", F.array_join(F.transform("left", lambda x: x["line"]), " - ").alias("residual"))
    found = sure.unionByName(partial)
    kind = F.coalesce(
        *[F.when(F.col("residual").rlike(r"^[\s¡¿\"'(\[*~_–-]*(?:" + "|".join(ps) + r")[\s!?.…,;:\"')\]*~_。！？–-]*$"), F.lit(k)) for k, ps in EVIDENCE.items()],
        F.when(F.col("residual").rlike(_PH_EDGE), F.lit("placeholder")),
        F.lit("mixed"),
    )
    return found.select(F.col("id").alias("entry_id"), kind.alias("kind"), "residual")
