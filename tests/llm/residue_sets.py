"""Texts of our own choice, none taken from the test tables. DEVELOPED were looked at while the exemplars were written; HELD_OUT were not, and LATER is a second such set, written after the exemplars' last change."""

DEVELOPED_RESIDUE = [
    "HTTP ERROR 500 This page isn't working", "Error establishing a database connection", "Your browser does not support JavaScript.", "Dear [FIRST_NAME], thanks.", "Diese Seite benötigt JavaScript.", "This is a sample paragraph, replace it.",
    "{{" + "a" * 80 + "}}", "${" + "b" * 70 + "}", "[insert a one-paragraph summary of what this project does]", "Hi {{ user.first_name }}, welcome back!", "Best regards,\n[Your Name]", "Just a moment...\n\nVerifying you are human. This may take a few seconds.",
    "502 Bad Gateway\nnginx/1.18.0 (Ubuntu)", "Sorry, the page you are looking for could not be found.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod.", "Your text goes here.", "Copyright %%YEAR%% by __COMPANY_NAME__", "Le contenu demandé: page introuvable.", "asdf asdf asdf asdf",
    "Access Denied\nYou don't have permission to access this server.", "JavaScript is disabled in your browser. Please enable it to continue.",
    "Sorry, this content isn't available right now",
    "404. That's an error. The requested URL was not found on this server. That's all we know.",
    "Our systems have detected unusual traffic from your computer network.",
    "Please verify you are a human",
    "We can't connect to the server at www.example.com.",
    "Hmm. We're having trouble finding that site.",
    "Internal Server Error - The server encountered an unexpected condition.",
    "Error 403: Forbidden. You do not have access to this resource.",
    "The service is currently unavailable. Please try again later.",
    "Your IP address has been blocked.",
    "This video is no longer available.",
    "Login required to view this content.",
    "Dear {{customer}},",
    "To: [Recipient Name]",
    "Price: $PRICE$ only",
    "Hello %FIRSTNAME%, thank you",
    "Order #{{ order_id }} confirmed",
    "<!-- TITLE -->",
    "Please insert your company description here.",
    "Add a description of your project here.",
    "Lorem ipsum dolor",
    "Vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor.",
    "Website coming soon",
    "Page en construction",
    "Seite im Aufbau",
    "Para continuar, habilite JavaScript en su navegador",
    "JavaScript is not enabled. Enable JavaScript and reload.",
    "This site requires cookies to function.",
    "Click here if you are not redirected automatically",
    "aaa aaa aaa aaa aaa",
    "[TODO: write introduction]",
    "TODO: insert company name",
    "Error: Connection refused",
    "Fatal error: Uncaught exception in index.php",
    "Warning: mysql_connect(): Access denied for user",
    "Sample Page Title - your subtitle goes here",
    "Untitled document",
    "DNS_PROBE_FINISHED_NXDOMAIN",
    "Account suspended. Contact your hosting provider.",
    "This domain is for sale.",
]
DEVELOPED_CONTENT = [
    "The server answered 502 twice last night, so the nightly copy was started again by hand.", "Our style guide says: use a placeholder such as [Your Name] only in drafts.", "Use `{{ user.first_name }}` in the mail template.", "The crawler now skips pages that say access denied.", "JavaScript and Python are the two languages of this repository.",
    "See [the manual](http://x.example/manual) and note [1] for more.", "- [x] tidy the backup\n- [ ] write the notes", "The team removed lorem ipsum from the landing page in March.", "We enable JavaScript linting in the build and run it on every branch.", "A very very large folder was moved to the archive drive.",
    "The service was unavailable for ten minutes while the disk was replaced.",
    "She enabled the alarm and left the building.",
    "The page was torn out of the book.",
    "Sign in sheets are kept by the door.",
    "We found no errors in the report.",
    "An error of two percent is acceptable.",
    "The site will be under construction until June, says the builder.",
    "Use curly braces such as {name} for fields.",
    "List of tags: [red] [green] [blue]",
    "Run it with <path> as the argument.",
    "The template system replaces each {{field}} `{{field}}` in turn.",
    "Coming soon after the war, the law changed everything.",
    "Nobody is a robot here, we are all people.",
    "The text goes here and there without a plan.",
    "His session with the doctor expired at noon.",
    "Please try the cake again later.",
    "The connection between diet and sleep is known.",
    "Description of the species: small, brown, loud.",
    "The team wrote the summary in two short sentences.",
    "A heading must be short.",
]

HELD_OUT_RESIDUE = [
    "Error 1020: Access denied. This website is using a security service to protect itself from online attacks.", "This site can't be reached", "The requested URL /index.php was not found on this server.", "Oops! That page can’t be found.", "We're sorry, but something went wrong.", "503 Service Temporarily Unavailable",
    "Whitelabel Error Page\nThis application has no explicit mapping for /error, so you are seeing this as a fallback.\nThere was an unexpected error (type=Not Found, status=404).", "Your session has timed out. Please log in again.", "Too many requests. Please slow down and try again in a few minutes.", "The server encountered an internal error and was unable to complete your request.",
    "Database connection failed", "Die angeforderte Seite wurde nicht gefunden.", "La page que vous recherchez n'existe pas.", "Lo sentimos, la página que busca no existe.", "Esta página não foi encontrada.", "You need to enable JavaScript to run this app.", "JavaScript must be enabled in order for you to use this site.", "Please turn on cookies and reload.", "Bitte aktivieren Sie JavaScript, um fortzufahren.",
    "Veuillez activer JavaScript dans votre navigateur.", "Please complete the CAPTCHA below to prove you are not a robot.", "Attention Required! | Cloudflare", "Checking if the site connection is secure", "This browser is no longer supported. Please upgrade to a modern browser.", "Dear {customer_name}, your order shipped.", "Sincerely, <Your Name>", "Hello *|FNAME|*,", "<%= render partial: 'footer' %> All rights reserved.",
    "Meeting with [Client Name] on [Date] at [Location].", "Project: #{project.title}", "Owner: $(OWNER_NAME)", "Coming soon!", "This page is currently under construction.", "Placeholder text for the about section.", "Type something here...", "Duis aute irure dolor in reprehenderit in voluptate velit.", "Hier steht ein Blindtext.", "test test test test", "Add your description here.", "qwertyuiop asdfghjkl",
]
HELD_OUT_CONTENT = [
    "After the update users reported that the page could not be found until the cache was cleared.", "We return 404 when a record is missing and 410 when it was deleted on purpose.", "The proxy logs show forty bad gateway answers between two and three in the morning.", "If JavaScript is off, the table falls back to plain HTML and the sort buttons vanish.", "Please enable two-factor sign-in for the release account before Friday.",
    "The article explains how Cicero's words became the lorem ipsum that printers use.", "Fixed a bug where {name} in \"{name}\" was not replaced.", "```\nHello {{ name }}\n```\nThis snippet greets a visitor.", "2024-03-01 10:12:44 ERROR fetcher: 503 Service Unavailable", "INFO worker: session expired, please log in again", "Array access such as a[i] is checked at run time.", "The matrix {1, 2, 3} has three entries.", "In C++ a vector<int> holds integers.",
    "Set x < 5 and y > 3 before you start.", "Mail goes to <support@example.org>.", "The colour was changed [sic] in the second edition.", "Under construction rules, the site manager signs each delivery of steel.", "The robot checks each browser window for stale tabs and closes them.", "A test of the test harness showed that tests were skipped.", "The sample text was collected from forty newspapers between 1990 and 2000.", "Our dog barked: woof woof, and the neighbours were not amused.",
    "Chapter 404 of the saga has not been found by any scholar so far.", "Access to the vault is denied to visitors after six.", "The word error comes from Latin errare, to wander.", "Something went wrong with the harvest that year, and prices doubled.", "Cookies and milk were served at the opening of the new wing.", "He asked whether they were human, and the robot laughed.", "The draft has a heading, a summary and two short paragraphs about rivers.", "Die Seite 12 des Berichts nennt die Kosten des Umbaus.", "La page douze du rapport donne le coût des travaux.",
]

LATER_RESIDUE = [
    "The page you are trying to view cannot be shown because the authenticity of the received data could not be verified.", "500 - Internal server error. There is a problem with the resource you are looking for, and it cannot be displayed.", "Sorry! We could not process your request.", "This account has been suspended.", "Not Found\n\nThe requested resource was not found on this server.", "We're experiencing technical difficulties. Please try again soon.",
    "You have reached your request limit. Try again in one hour.", "Forbidden: you do not have permission to access / on this server.", "Enable JavaScript and cookies to continue", "Your browser has JavaScript turned off.", "Please allow cookies to use this site.", "Performing security verification", "Are you human? Please complete the challenge.", "Invoice for {{ client.name }}", "[Your Company Name] - [Your Address]", "Kind regards, ${sender_name}", "Hello [[first_name]]!", "Insert your tagline here",
    "Curabitur blandit tempus porttitor. Nullam quis risus eget urna mollis ornare vel eu leo.", "More information coming soon.", "Under construction", "test test test", "Diese Website benötigt Cookies.", "Une erreur est survenue. Veuillez réessayer plus tard.",
]
LATER_CONTENT = [
    "The company moved its address to Lisbon in spring.", "Requests to the museum are answered within one hour.", "A cookie recipe needs butter, flour and sugar.", "The new browser shows tabs on the left side.", "We verified the seal of every container.", "The server brought the soup and apologised for the delay.", "Errors in the census were found by two students.", "It was not found in the ruins but in the river.", "The old road is under construction near the bridge.",
    "Her account of the journey was suspended between fact and dream.", "More information about the birds is in chapter two.", "The team has ten people, each with one role.", "The summary of the meeting was sent on Monday.", "Try the second door if the first is locked.", "Les pages du livre sont introuvables dans cette bibliothèque depuis la guerre.", "Der Zugriff auf das Archiv wurde nach dem Brand neu geregelt.",
]
