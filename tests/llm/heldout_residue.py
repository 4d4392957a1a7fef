"""Texts for problem 10 that do not stand among the exemplars. ``RESIDUE`` showed what was missing; nothing was changed for ``UNSEEN``."""

RESIDUE = [
    "Oops! That page can't be found.",
    "Error establishing a database connection",
    "JavaScript is required to view this page",
    "Dear [First Name],",
    "<INSERT NAME>",
    "Signed on [Insert date]",
    "Just a moment... verifying you are human",
    "Sorry, your browser\ndoes not support JavaScript.",
    "You must have JavaScript enabled to use this application.",
    "This website needs JavaScript. Please activate it in your browser settings.",
    "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.",
    "HTTP Error 404 - File or directory not found.",
    "404 - This page does not exist",
    "Error 403: Forbidden",
    "Error 502 Bad gateway",
    "HTTP 503 - Service unavailable",
    "The server encountered an internal error. Please try again later.",
    "The page you requested was not found.",
    "We could not find the page you were looking for.",
    "Access to this page has been denied",
    "You are not authorized to view this page.",
    "Your session timed out. Please log in again.",
    "This site can't be reached",
    "The connection has timed out",
    "Sorry, something went wrong.",
    "Our site is undergoing maintenance. We will be back soon.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
    "Sed ut perspiciatis, dolor sit amet aliqua magna dolore",
    "Placeholder text goes here",
    "Replace this paragraph with your own content.",
    "Add your text here",
    "Sample paragraph",
    "Hello {{ user.first_name }}, welcome back",
    "Invoice for ${customer}",
    "To: [Your Name]",
    "Meeting at <insert location here>, details follow",
    "Author: [Author name here]",
    "Our company, %company_name%, is proud",
    "Cette page est introuvable.",
    "Merci d'activer JavaScript dans votre navigateur",
    "Diese Seite wurde leider nicht gefunden",
    "Bitte JavaScript im Browser aktivieren",
    "La página no existe",
    "Por favor, habilite JavaScript en su navegador",
    "Esta página não existe",
    "Страница не существует",
    "Пожалуйста, включите JavaScript в браузере",
    "您访问的页面不存在",
    "请在浏览器中启用 JavaScript",
    "The gauge was read at noon and the crew left at four. Sorry, this page could not be found. The report continues on the next sheet.",
    "Whoops, looks like something went wrong.",
    "Page Not Found - we couldn't find what you were looking for",
    "The requested resource could not be located on this server.",
    "This webpage is not available",
    "ERROR 500: Internal server error occurred",
    "Sorry, you do not have access to this document.",
    "429 Too Many Requests",
    "Gateway timeout (504)",
    "Database connection error",
    "Your login session has expired",
    "The service is temporarily unavailable",
    "JavaScript has been disabled in your browser",
    "Please allow JavaScript to run on this site",
    "To view this content, enable JavaScript.",
    "JavaScript must be enabled to display this page",
    "Please complete the captcha to prove you are not a robot",
    "Your browser has JavaScript turned off",
    "Dear <your name>,",
    "Prepared by: [full name]",
    "Deadline: [TBD]",
    "Address: <insert address>",
    "{{first_name}}",
    "Total: ${amount} EUR",
    "[[subject]]",
    "Insert your text here",
    "This is dummy text.",
    "Text goes here",
    "Sample content, to be replaced",
    "Zugriff auf diese Seite verweigert",
    "Erreur 500: erreur interne du serveur",
    "Acceso prohibido a este documento",
    "Página no disponible: error 404",
    "Доступ к странице запрещён",
    "该页面不存在",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum",
]
UNSEEN = [
    "Sorry! This page isn't available.",
    "404: NOT FOUND",
    "Error: could not connect to database server",
    "An internal error has occurred. Try again later.",
    "Access forbidden",
    "You do not have permission to view this directory or page.",
    "Session expired, please sign in again",
    "Connection refused by the server",
    "Site under maintenance",
    "Turn on JavaScript to continue",
    "Your browser has scripts disabled. Enable them and reload.",
    "This page needs JavaScript to work",
    "Hi {{ name }}!",
    "Name: [your full name]",
    "Client: <client name>",
    "Date: [dd.mm.yyyy]",
    "Insert content here",
    "Write your text here",
    "This is sample text, replace it",
    "Nulla vitae velit ante, risus quisque sodales",
    "JavaScript ist in Ihrem Browser deaktiviert",
    "Cette page n'est pas disponible",
    "Se requiere JavaScript para ver esta página",
    "Ошибка 404: страница не найдена",
    "服务器错误",
]
CONTENT = [
    "If the server answers 404, the crawler notes the page and goes on.",
    "2024-01-01 10:00:00 ERROR [web] 503 Service Unavailable after 3 tries",
    "Our template prints `{{ name }}` and the build fills it in.",
    "The script enables the pump when the pressure is off.",
    "Access to the hangar was denied to visitors for two weeks in spring.",
    "He could not find the page with the torque table, so he asked the clerk.",
    "We tried the page without JavaScript and the charts were missing, but the tables stayed readable.",
    "The designer used lorem ipsum for the draft and replaced it in June.",
    "Error bars in figure 404 show the standard deviation of the runs.",
    "The name of the operator is written in field [7] of the form.",
    "Results (see table 3) are given in [mm] and [kg].",
    "Voltage <12 V and >9 V is fine.",
    "Turn the switch off before you open the housing.",
    "cp \"${SRC}/data\" /srv/backup",
    "| name | date | value |",
    "The maintenance of the engine takes two hours.",
    "A bad gateway valve was replaced in the afternoon.",
    "Please enter the hangar through the north gate.",
    "Room 500 holds the internal server racks and the error counters.",
    "My text is not yet written, but the title is.",
]
