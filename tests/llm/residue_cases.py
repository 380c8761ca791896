"""Sentences for the residue detector, written by hand and not taken from any table.

All lists were written together, by the author of the vocabulary and after a first version of it. ``RESIDUE`` and ``ORDINARY``
were then used to mend it; what was missed of the ``HELD_OUT`` lists was not looked at, only their recall and precision.
"""

RESIDUE = [
    "JavaScript is disabled in your browser.", "This page requires JavaScript to be enabled", "You have JavaScript turned off.", "Scripts are blocked by your browser settings.", "To use this site, please allow scripts and cookies.",
    "503 Service Unavailable", "HTTP Error 500 - Internal Server Error", "Something went wrong. Please try again later.", "Oops! We can't find the page you're looking for.", "The server is temporarily unable to process your request. The service is unavailable.", "404 - File or directory not found.",
    "The connection has timed out", "Your session timed out. Please sign in.", "You don't have permission to access this resource.", "This document is no longer available.", "The file could not be loaded.", "Request failed with status code 502", "Site under maintenance", "Rate limit exceeded, try again later",
    "[TODO: describe]", "Insert title here", "[Applicant name]", "{{company}}", "Your text here", "Enter a short summary here.", "TBD TBD TBD", "Description to be provided.", "${inventor.name}",
    "Bitte schalten Sie JavaScript ein.", "Die Seite konnte nicht gefunden werden. Seite nicht gefunden", "Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.", "Der Server ist nicht erreichbar.", "Titel hier eingeben", "JavaScript ist in Ihrem Browser deaktiviert.",
    "JavaScript est désactivé dans votre navigateur.", "La page demandée est introuvable.", "Le service est temporairement indisponible.", "Une erreur s'est produite, veuillez réessayer.", "Saisir le titre ici", "Résumé à compléter",
    "JavaScript está desactivado en su navegador.", "No se ha encontrado la página.", "El servidor no está disponible.", "Ha ocurrido un error. Inténtelo de nuevo.", "Escribir el resumen aquí", "Texto por completar",
    "Errore interno del server", "Pagina non disponibile", "Ocorreu um erro ao carregar a página", "De pagina is niet beschikbaar", "Traceback (most recent call last):", "at org.app.Main.run(Main.java:42)", "See Error! Bookmark not defined. for the drawing.", "Lorem ipsum dolor sit amet",
]
ORDINARY = [
    "The server answers 404 not found for a missing resource.", "An internal server error is logged by the monitor.", "The controller returns an access denied response.", "If JavaScript is disabled, the browser (12) shows a static view.", "The renderer requires JavaScript to be enabled in the browser (14) before the page is drawn.",
    "When the session has expired, the user must log in again.", "The unit checks whether the page was found.", "A message such as \"Page not found\" is displayed.", "The proxy reports a gateway timeout to the client (3).", "The template engine replaces the placeholder {{title}} with the stored title.",
    "The connection between the pipe and the tank has failed in earlier designs because of corrosion.", "Access to the chamber is denied by a latch.", "The description here refers to the drawings.", "The user enters the title here shown in Figure 3 by means of the keyboard (7).", "The method of claim 1, wherein an error code 503 is sent when the service is unavailable.",
    "Der Server meldet einen Fehler 404, wenn die Seite nicht gefunden wird.", "Die Verbindung der Platten ist in bekannten Vorrichtungen unterbrochen, sobald der Druck steigt.", "Le serveur renvoie une erreur 500 lorsque la base de données est indisponible.", "El servidor devuelve un error cuando la página no se encuentra.", "The script that runs in the browser loads the page.",
    "In the text of the claims, the word here means the housing.", "The service is requested by the terminal (4) and the response is stored.", "A timeout of the connection causes the gateway (8) to retry the request.", "The summary of the invention is given in claim 1.", "The word lorem is used as a sample text in the panel (3).",
    "The placeholder text is replaced at run time by the name of the user.", "The field [0032] of the record is read by the parser.", "The document can be found by its number.", "To enable scripts to be executed, the interpreter (22) is provided.", "The requested page is fetched from the server and drawn.",
]
HELD_OUT_RESIDUE = [
    "Please turn on JavaScript and reload the page.", "JavaScript must be enabled in order for you to use this viewer.", "Sorry, your browser does not support JavaScript!", "Cookies are disabled. Enable cookies to continue.", "This application needs JavaScript to run.",
    "HTTP 403: Forbidden", "Error 502 Bad Gateway", "The page you requested does not exist.", "We are unable to load this document.", "Login required. Your session has ended: session expired.", "Unable to connect to the database", "Database error: connection refused", "The requested URL was not found on this server.", "An error occurred while processing your request.", "This site can't be reached", "500 Internal Server Error nginx", "Sorry, this content is currently unavailable.", "Too many requests. Please try again in a few minutes.",
    "[Insert abstract]", "<<client_name>>", "[Your company]", "Type your title here", "Claims to follow", "Summary: to be completed", "Replace this text", "[TBD]", "Add your description here", "%%DATE%%",
    "JavaScript muss aktiviert sein, um diese Seite anzuzeigen.", "Fehler 500: Interner Serverfehler", "Zugriff verweigert. Sie haben keine Berechtigung.", "Das Dokument konnte nicht geladen werden.", "Die Verbindung zum Server wurde unterbrochen.", "Beschreibung hier einfügen",
    "Veuillez activer les scripts de votre navigateur.", "Erreur 503 - Service indisponible", "Accès interdit", "Le document n'a pas pu être chargé.", "Insérer la description ici", "Habilite JavaScript para continuar.", "Error 404: documento no encontrado", "Acceso denegado. Inicie sesión de nuevo.", "La sesión ha expirado.", "Insertar título aquí",
    "Abilitare i cookies e JavaScript", "Accesso negato", "Sessão expirada. Sessão expirou, faça login novamente.", "Toegang geweigerd", "java.lang.NullPointerException", "Uncaught TypeError: x is undefined", "dolor sit amet consectetur adipiscing elit", "qwerty asdf foo bar test test",
]
HELD_OUT_ORDINARY = [
    "The gateway returns status 502 whenever the upstream server fails to answer.", "A page not found condition is signalled to the crawler (18).", "The browser indicates that JavaScript is not supported.", "Scripts are executed only after the page has been loaded by the terminal (6).", "An unauthorized request is refused by the firewall (11) and logged.",
    "The lamp lights up if the connection was lost.", "According to the invention, access is refused as soon as the token expires.", "The error handler displays the text \"Service unavailable\" to the operator.", "The form contains a box in which the user types a title.", "The variable ${name} is expanded by the shell, such as ${name} in the example.", "The placeholder {{user}} is filled by the server.",
    "The seal failed after 300 hours at 80 degrees.", "The summary is stored here and later displayed on the screen (9).", "The abstract of the document is generated automatically by the module.", "A missing record is treated as not found by the database engine (30).", "The system restarts when an internal error occurs in the controller.",
    "Die Anzeige zeigt den Text „Zugriff verweigert“.", "Der Dienst ist nicht erreichbar, wenn die Verbindung zwischen Client (2) und Server (3) fehlt.", "Eine fehlerhafte Anfrage wird vom Server (4) abgelehnt.", "Ein Skript aktiviert die Pumpe (8).", "Lorsque la session a expiré, l'utilisateur se reconnecte au serveur (5).", "La vanne est bloquée et l'accès au réservoir est interdit par le loquet (7).", "El mensaje «Página no encontrada» aparece en la pantalla.", "El acceso a la cámara es denegado por la válvula (6).",
    "The time-out of the watchdog is 40 ms.", "The required service life is not available with known coatings because the layer (3) wears.", "Here, the text refers to the first embodiment.", "The claims are to be completed with the features described above.", "The user is asked to enter a date, which is stored in the memory (12).", "Testing was done with samples test 1, test 2 and test 3.",
]
