"""Feature names, dimensions and pattern banks.

Everything in this module is a set of FIXED VALUES: the names, their order and
the regular expressions define what the 19 features mean, so they have to be
exactly these for results to be comparable.  The expressions use the usual
``\\b`` / ``$`` notation; :mod:`talkprint.functions.text` translates that to
Spark's regex dialect.  A caller may pass its own banks to add features.
"""

# --- fixed values: the 19 features in vector order, by dimension -------------
DIMENSIONS = {
    "D1": [
        "words_per_turn",
        "short_utterance_rate",
        "politeness_rate",
        "formality_rate",
        "acknowledgment_rate",
        "verbosity_cv",
        "repetition_rate",
        "identity_confusion_rate",
    ],
    "D2": ["front_loading_ratio", "identifiers_per_turn", "opening_length"],
    "D3": [
        "uncertainty_rate",
        "certainty_rate",
        "pushback_rate",
        "clarification_question_rate",
        "info_seeking_rate",
    ],
    "D4": ["emotional_expression_rate", "accusatory_rate", "strategy_pivot_rate"],
}
FEATURES = [name for names in DIMENSIONS.values() for name in names]

# --- fixed values: one bank per rate feature ---------------------------------
BANKS = {
    "politeness_rate": [
        r"\bplease\b", r"\bpls\b", r"\bplz\b", r"\bthanks?\b", r"\bthank you\b", r"\bthx\b",
        r"\bty\b", r"\bcheers\b", r"\bmuch appreciated\b", r"\bappreciate\b", r"\bappreciated\b",
        r"\bgrateful\b", r"\bsorry\b", r"\bapologies\b", r"\bmy apologies\b", r"\bpardon\b",
        r"\bexcuse me\b", r"\bkindly\b", r"\bif you don't mind\b", r"\bif you wouldn't mind\b",
        r"\bwould you mind\b", r"\bif possible\b", r"\bif you can\b",
        r"\bwhen you (?:get|have) (?:a|the) (?:chance|moment|minute)\b",
        r"\bno (?:worries|rush|problem)\b",
    ],
    "formality_rate": [
        "—", "–", r";",
        r"\bfurthermore\b", r"\bmoreover\b", r"\bin addition\b", r"\badditionally\b",
        r"\btherefore\b", r"\bthus\b", r"\bhence\b", r"\bconsequently\b", r"\baccordingly\b",
        r"\bsubsequently\b", r"\bhowever\b", r"\bnevertheless\b", r"\bnonetheless\b",
        r"\bnotwithstanding\b", r"\bregarding\b", r"\bwith (?:regard|respect) to\b",
        r"\bin (?:regard|respect) to\b", r"\bpertaining to\b", r"\bconcerning\b", r"\bindeed\b",
        r"\bper se\b", r"\bas such\b",
    ],
    "identity_confusion_rate": [
        r"\bhow (?:may|can) i (?:help|assist)\b",
        r"\blet me (?:check|look into|assist|pull up|find|locate|verify|confirm)\b",
        r"\bi(?:'ll| will) (?:look|check|verify|pull|find|look into) (?:that|this) for you\b",
        r"\bi apologize for (?:the|any) (?:inconvenience|confusion|delay|trouble|wait)\b",
        r"\bthank you for (?:your patience|your time|contacting|reaching out|your inquiry)\b",
        r"\bis there anything (?:else|further) i can (?:help|assist|do)\b",
        r"\bi(?:'d| would) be (?:happy|glad|delighted) to\b",
        r"\bplease (?:hold|wait|allow|give) (?:a moment|one moment|me a moment|while i)\b",
        r"\bone moment please\b", r"\bbear with me\b",
        r"\bour records (?:show|indicate|reflect)\b",
        r"\bfor (?:security|verification) (?:purposes|reasons)\b",
        r"\bper (?:our|company|store) policy\b", r"\brest assured\b", r"\bon behalf of\b",
        r"\bi(?:'ve| have) (?:gone ahead and|processed|submitted|escalated)\b",
    ],
    "uncertainty_rate": [
        r"\bmaybe\b", r"\bperhaps\b", r"\bpossibly\b", r"\bprobably\b", r"\bnot sure\b",
        r"\bi(?:'m| am)? not sure\b", r"\bunsure\b", r"\bi think\b", r"\bi guess\b",
        r"\bi suppose\b", r"\bi believe\b",
        r"\bi(?:'m| am) not (?:entirely |completely |totally )?certain\b",
        r"\b(?:dunno|don't know|do not know|no idea)\b", r"\bidk\b",
        r"\b(?:kinda|kind of|sort of|sorta)\b", r"\b(?:might|could|may) be\b",
        r"\bapparently\b", r"\bpresumably\b", r"\bseemingly\b",
        r"\bif i (?:recall|remember) correctly\b", r"\biirc\b", r"\bhmm+\b",
    ],
    "certainty_rate": [
        r"\bdefinitely\b", r"\babsolutely\b", r"\bcertainly\b", r"\bsurely\b", r"\bundoubtedly\b",
        r"\bpositively\b", r"\bfor sure\b", r"\bfor certain\b", r"\bno doubt\b",
        r"\bwithout a doubt\b", r"\bexactly\b", r"\bprecisely\b", r"\bclearly\b", r"\bobviously\b",
        r"\bi(?:'m| am) (?:sure|certain|positive|confident)\b", r"\bguaranteed\b",
        r"\b100\s*%\b", r"\bhundred percent\b",
    ],
    "pushback_rate": [
        r"\bare you (?:sure|certain|serious)\b", r"\byou (?:already )?asked\b",
        r"\bi already (?:told|said|mentioned|explained)\b",
        r"\bi (?:just|literally) (?:said|told you|mentioned)\b",
        r"\bthat's not (?:right|correct|what i|true)\b", r"\bthat(?:'s| is) (?:wrong|incorrect)\b",
        r"\bthat doesn(?:'t| not) (?:sound|seem|look) right\b", r"\bi disagree\b",
        r"\bi don't (?:think|believe) (?:that's|so)\b",
        r"\bas i (?:said|mentioned|explained|noted)\b", r"\blike i (?:said|told you|mentioned)\b",
        r"\bhow many times\b", r"\bdidn(?:'t| not) i (?:just )?(?:say|tell)\b",
        r"\bwe (?:already )?(?:discussed|covered|went over)\b",
        r"\byou(?:'re| are) not listening\b", r"\bread what i (?:wrote|said|typed)\b",
        r"\bscroll up\b",
    ],
    "clarification_question_rate": [
        r"what do you mean", r"what does that mean",
        r"can you (?:clarify|explain|elaborate|rephrase)",
        r"could you (?:clarify|explain|elaborate|rephrase|repeat)",
        r"i(?:'m| am) not sure i understand", r"i don't (?:understand|follow|get it)",
        r"i(?:'m| am) (?:confused|lost)", r"what exactly", r"what specifically",
        r"can you be more specific", r"which (?:one|do you mean|should i)", r"\bhuh\??",
        r"\bwhat\??$", r"\bsorry\??$", r"\bpardon\??$", r"\bcome again\b", r"can you repeat",
        r"say that again", r"\bwait,? what\b",
    ],
    "info_seeking_rate": [
        r"what is the (?:status|update|eta|situation)\b", r"what(?:'s| is) the (?:status|update)\b",
        r"any (?:update|updates|news|info|information)\b",
        r"can you (?:check|confirm|verify|look up)\b", r"is there a way to\b",
        r"is it possible to\b", r"how (?:do|can|could|would|should) i\b",
        r"where (?:do|can|should) i\b", r"when (?:will|does|is|can)\b",
        r"why (?:is|does|do|are|am)\b", r"who (?:do|should|can) i\b",
        r"what (?:are|were|is) the\b", r"what about\b",
        r"could you (?:tell|let|show|send|share) me\b",
        r"(?:please )?tell me (?:about|what|how|when|where|why)\b", r"do you (?:know|have)\b",
        r"i need (?:to know|the|an)\b",
    ],
    "emotional_expression_rate": [
        r"\bfrustrat(?:ed|ing|ion)\b", r"\bannoyed\b", r"\bannoying\b", r"\birritat(?:ed|ing)\b",
        r"\bfed up\b", r"\bangry\b", r"\bmad\b", r"\bfurious\b", r"\bpissed\b", r"\bupset\b",
        r"\bdisappoint(?:ed|ing|ment)\b", r"\bstressed\b", r"\bworried\b", r"\banxious\b",
        r"\bexhausted\b", r"\btired of\b", r"\bsick of\b", r"\b(?:ugh+|argh+|grr+)\b",
        r"\boh (?:come on|no|man)\b", r"\bcome on\b", r"\bridiculous\b", r"\babsurd\b",
        r"\binsane\b", r"\boutrageous\b", r"\bunbelievable\b", r"\bdisgraceful\b",
        r"\bnever ?mind\b", r"\bforget it\b", r"\bforget (?:that|this)\b",
        r"\bthis is (?:taking|getting|becoming|so|really)\b", r"\bseriously\??", r"\bwtf\b",
        r"\bffs\b",
    ],
    "accusatory_rate": [
        r"\buseless\b", r"\bunacceptable\b", r"\bincompetent\b", r"\bunprofessional\b",
        r"\bscam\b", r"\bfraud(?:ulent)?\b", r"\brip[- ]?off\b", r"\bripped me off\b",
        r"\b(?:ly|lying|liar|dishonest|deceptive)\b", r"\bcheat(?:ed|ing|er)?\b", r"\bworst\b",
        r"\bterrible\b", r"\bhorrific\b", r"\bhorrible\b", r"\bawful\b", r"\bappalling\b",
        r"\bshameful\b", r"\bpathetic\b", r"\ba joke\b", r"\btotal joke\b",
        r"\bwaste of (?:time|my time|money)\b", r"\byou(?:'re| are) not (?:helping|helpful|listening)\b",
        r"\bdo your job\b",
    ],
    "strategy_pivot_rate": [
        r"\binstead\b", r"\brather than\b", r"\bin that case\b", r"\bon second thought\b",
        r"\bactually(?:,| let| i| we)\b", r"\blet(?:'s| us) try\b", r"\blet me try\b",
        r"\bhow about\b", r"\bhow about this\b", r"\balternatively\b",
        r"\banother (?:option|way|approach|idea)\b", r"\bwhat if (?:we|i|you)\b",
        r"\bor (?:maybe|perhaps|else)\b", r"\bcan we (?:try|do) something (?:else|different)\b",
        r"\bdifferent approach\b", r"\bchange of plans\b", r"\bnew plan\b", r"\bscratch that\b",
        r"\bforget (?:it|that)\b",
    ],
}

# --- fixed values: whole-utterance acknowledgments ---------------------------
ACKNOWLEDGMENTS = [
    "ok", "okay", "k", "kk", "sure", "got it", "alright", "yes", "yeah", "yea", "yep", "yup",
    "no", "nope", "nah", "right", "fine", "great", "cool", "awesome", "nice", "thanks",
    "thank you", "thx", "ty", "cheers", "understood", "noted", "copy", "copy that", "roger",
    "roger that", "ack", "acknowledged", "i see", "perfect", "sounds good", "sounds great",
    "works for me", "will do", "gotcha", "got you", "makes sense",
]
