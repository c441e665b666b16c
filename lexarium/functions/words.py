"""Word lists. Results depend on these very words."""

from __future__ import annotations

STOPWORDS = {
    "en": (
        "a an the and or but if then else when at from by for with about against between into through during before after above below to up down in out on off "
        "over under again further once here there where why how all any both each few more most other some such no nor not only own same so than too very s t "
        "can will just don should now"
    ).split(),
    "de": (
        "der die das den dem des ein eine einer eines einem einen ist sind war waren wird werden wurde wurden hat haben hatte hatten kann können konnte konnten "
        "muss müssen musste mussten soll sollen sollte sollten wollen wollte wollten darf dürfen durfte durften mag mögen mochte mochten und oder aber denn weil "
        "wenn als ob damit obwohl während nachdem bevor sobald seit bis indem ohne außer gegen für mit zu von bei nach aus über unter neben zwischen vor hinter "
        "auf um herum durch entlang ich du er sie es wir ihr mich dich ihn uns euch ihnen mein dein sein unser euer ihre ihres ihrem ihren"
    ).split(),
}

#: Terms that a query is widened by.
EXPANSIONS = {
    "purpose": "Zweck",
    "goal": "Ziel",
    "application": "Anwendung",
    "scope": "Anwendungsbereich",
    "safety": "Sicherheit",
    "requirements": "Anforderungen",
    "standard": "Norm",
    "toy": "Spielzeug",
}
