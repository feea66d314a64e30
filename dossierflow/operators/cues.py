"""Cues of reply classes: ordered word sets, and the patterns built from them.

A cue is a tuple of word sets: a sentence has it if a word (or fixed phrase) of each set stands in it in that order, with at most ``GAP`` other
words between neighbours. A set of one phrase is a plain phrase. The lists are data; the gap rule is the only logic.
"""
from __future__ import annotations

#: Other words that may stand between two sets of a cue.
GAP = 4

# Word sets that several cues use.
MEETINGS = ("appointment", "call", "chat", "conversation", "discussion", "interview", "interviews", "meeting")
GLAD = ("delighted", "glad", "happy", "pleased")
NOT = ("cannot", "can't", "not", "unable", "won't", "won’t")
ONWARD = ("continue", "forward", "further", "go ahead", "proceed", "proceeding", "progress", "progressing", "pursue")
OTHERS = ("another", "different", "other")
CANDIDATES = ("applicant", "applicants", "candidate", "candidates")
CHOSEN = ("selected", "shortlisted", "successful")
ARRANGE = ("arrange", "book", "organise", "organize", "schedule", "set up")
SHIFT = ("change", "move", "postpone", "rearrange", "reschedule")
INVITE = ("invite", "inviting")
FILED = ("application", "cv", "resume", "résumé")
RECEIVED = ("received", "submitted")
SHARE = ("confirm", "forward", "let us know", "provide", "send", "share", "tell us")
PAPERS = ("a copy", "certificates", "copies", "details", "documents", "the following", "whether", "your")
FILLED = ("besetzt", "vergeben")
TALK = ("gespräch", "interview", "vorstellungsgespräch")
OTHER_DE = ("andere", "anderen", "anderer")
CANDIDATES_DE = ("bewerber", "bewerberin", "bewerberinnen", "bewerbern", "kandidat", "kandidaten", "kandidatin", "kandidatinnen")

# Cues of each class, by language.
CUES: dict[str, dict[str, tuple[tuple[tuple[str, ...], ...], ...]]] = {
    "bounce": {
        "en": ((("undeliverable", "undelivered", "returned mail", "address not found", "delivery status notification", "mail delivery subsystem"),),
               (("delivery",), ("failed",)), (("could not be",), ("delivered",))),
        "de": ((("unzustellbar", "nicht zugestellt"),),),
        "fr": ((("non remis", "échec de remise", "échec de la remise"),),),
    },
    "delay": {"en": ((("delay", "delayed", "not been delivered yet"),),), "de": ((("verzögert",),),), "fr": ((("retardé", "retardée"),),)},
    "away": {
        "en": ((("out of office", "out of the office", "on leave", "back in the office"),), (("on",), ("annual", "business", "maternity", "parental", "sick"), ("leave",)),
               (("away from",), ("desk", "office")), (("limited access",), ("e-mail", "email")), (("i will",), ("back", "be back", "be returning", "returning"))),
        "de": ((("abwesend", "abwesenheit", "im urlaub", "nicht im büro"),),),
        "fr": ((("absent du bureau",),),),
    },
    "offer": {
        "en": ((GLAD, ("extend",), ("offer",)), (GLAD, ("offer you",)), (("offer letter", "offer of employment", "employment offer", "formal offer", "job offer", "written offer"),)),
        "de": ((("vertragsangebot",),), (("freuen uns",), ("position", "stelle"), ("anzubieten",))),
        "fr": ((("proposition d'embauche",),),),
        "ar": ((("عرض عمل", "عرض وظيفي"),),),
    },
    "rejection": {
        "en": ((("regret to inform", "decision not to"),), (NOT, ("moving", "taking", "move", "take", "be moving", "be taking"), ONWARD), (("decided not to",), ONWARD),
               (("decided to",), ONWARD, OTHERS), (("not been", "been", "was", "were"), ("not",), CHOSEN), (("not been",), CHOSEN), (("been", "was", "were"), ("unsuccessful",)),
               (OTHERS, CANDIDATES, ("better", "closely", "more")), (("more closely",), ("match", "matched", "matches")), (("will not be",), (*ONWARD, "considered", "moving")),
               (("not",), INVITE, ("you",)), (("not",), ONWARD, ("application", "candidacy")), (("not able to", "unable to"), (*ONWARD, "offer you", "take your application")),
               (("position",), ("been filled",)), (("no longer",), ("available", "being considered"))),
        "de": ((("absage", "absagen"),), (("nicht",), ("berücksichtigen", "berücksichtigt")), (OTHER_DE, CANDIDATES_DE), (("nicht",), ("engere",), ("auswahl", "wahl")),
               (("nicht zu",), TALK), (("position", "stelle"), FILLED), (("bereits",), FILLED)),
        "fr": ((("nous ne pouvons pas donner suite", "pas été retenu", "pas été retenue"),),),
    },
    "weak_rejection": {"en": ((("unfortunately", "we regret"),),), "de": ((("leider",),),), "fr": ((("malheureusement",),),), "ar": ((("نأسف", "للأسف", "نعتذر"),),)},
    "interview": {
        "en": ((INVITE, ("you",), MEETINGS), (ARRANGE, MEETINGS), (("offer you",), MEETINGS), (("interview",), ("at", "invitation", "invite", "on", "slot", "with")),
               (("your availability",),), (("available for",), MEETINGS), (("assessment center", "assessment centre"),), (SHIFT, MEETINGS)),
        "de": ((("kennenlernen", "kennenlerngespräch", "vorstellungsgespräch", "vorstellungsgespräche", "vorstellungsgesprächs", "terminvorschlag", "terminvorschläge"),),
               (("einladung",), TALK), (("termin",), ("verschieben",))),
        "fr": ((("entretien",),),),
        "ar": ((("مقابلة",),),),
    },
    "info": {
        "en": ((("can you", "could you", "please", "would you"), SHARE, PAPERS), (("expected salary", "salary expectation", "salary expectations", "notice period", "visa status"),),
               (("current",), ("ctc", "package", "salary")), (("earliest", "possible"), ("date",))),
        "de": ((("gehaltsvorstellung", "gehaltsvorstellungen", "kündigungsfrist", "kündigungsfristen", "eintrittstermin"),), (("bitte",), ("schicken sie", "senden sie", "teilen sie"))),
        "fr": ((("pourriez-vous",),),),
    },
    "ack": {
        "en": ((("we", "we've", "we’ve"), RECEIVED, FILED), (("thank you for", "thanks for"), ("application", "applying", "interest")), (("your application",), RECEIVED),
               (("application",), RECEIVED), (("we shall", "we will", "we'll", "we’ll"), ("be in touch", "contact you", "get back", "review"))),
        "de": ((("eingang ihrer bewerbung", "eingang ihrer bewerbungsunterlagen"),), (("ihre bewerbung",), ("eingegangen",)),
               (("vielen dank für ihre bewerbung", "vielen dank für ihre bewerbungsunterlagen"),)),
        "fr": ((("nous avons",), ("reçu votre candidature",)),),
        "ar": ((("تم استلام", "شكرا لتقديم", "شكراً لتقديم"),),),
    },
}

# Subjects that begin with these words.
RECEIPT_SUBJECTS = ("gelesen", "leido", "leído", "letto", "lido", "lu", "read")
AWAY_SUBJECTS = ("abwesend", "abwesenheitsnotiz", "auto reply", "auto-reply", "automatic reply", "automatic-reply", "automatische antwort", "autoreply", "out of office",
                 "réponse automatique")

# What keeps a cue from counting, before it or after it in the same sentence.
SUITED = ("application", "background", "cv", "experience", "fit", "profile", "qualifications", "selected", "shortlisted", "skills", "successful", "suitable")
NEGATIONS = ((("cannot", "kein", "keine", "keinen", "never", "nicht", "no", "not", "pas", "unable"),),)
PAST = ((("after", "attended", "attending", "following", "since", "thank for", "thank you for", "thanks for"),),)
CONDITIONS = ((("if", "if your", "if you are", "if you're", "in case you are", "in case your", "should you be", "should your"), SUITED), (("only shortlisted",),),
              (("falls ihr", "falls ihre", "falls sie", "gegebenenfalls", "ggf", "sofern"),), (("sollten sie",), ("ausgewählt", "engere")))
PERHAPS = ((("arrange", "contact", "invite", "reach out", "schedule"),),)
CONDITIONS_AFTER = ((("if", "if you are", "if you're", "if your", "once your", "once you are", "when your", "when you are"), SUITED),
                    (("falls ihr", "falls ihre", "sofern ihr", "sofern ihre", "wenn ihr", "wenn ihre"), ("erfahrung", "profil", "qualifikation")))
SILENCE = ((("if you", "in case", "in event", "in the event", "should you"), ("did not", "didn't", "do not", "don't", "have not", "haven't", "not")),
           (("please accept", "please assume", "please consider"),), (("falls sie", "sollten sie"), ("bis", "innerhalb", "keine", "nichts")), (("sans nouvelles", "sans réponse"),))
WARNINGS = ((("fee", "fees", "fraud", "fraudulent", "never", "pay", "payment", "scam"),),)
NOT_A_JOB = ((("call", "chance", "interview", "invitation", "meeting", "place", "slot"),), (("opportunity to",), ("interview", "meet", "speak")))


def words(terms) -> str:
    return "(?:" + "|".join(t.replace(" ", r"\s+") for t in sorted(terms, key=len, reverse=True)) + ")"


def cue(sets) -> str:
    """The word sets in order, up to ``GAP`` other words between neighbours."""
    return rf"(?:[^\p{{L}}\p{{N}}.!?\n]+[\p{{L}}\p{{N}}'’-]+){{0,{GAP}}}?[^\p{{L}}\p{{N}}.!?\n]+".join(map(words, sets))


def any_of(cues) -> str:
    """One of the cues between word borders, in any case."""
    return r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(map(cue, cues)) + r")(?![\p{L}\p{N}])"


def of_class(name: str) -> str:
    return any_of(c for own in CUES[name].values() for c in own)
