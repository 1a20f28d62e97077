"""Rule tables. They are ordinary data: every operator takes a table of its own in place of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rules on the accepted and rejected views of a paragraph (name, pattern).
VIEW_RULES = [
    ("double_article", r"(?iU)\b(?:the|a|an)\s+(?:the|a|an)\b"),
    ("repeated_word", r"(?iU)\b(\w{3,})\s+\1\b"),
    ("stranded_preposition", r"(?U)\b(?:to|of|in|for|on|at|by|with|from|into|under|over|within|between|among)\s*[.,;:)]"),
    ("missing_space_between_words", r"(?U)\S[.,;:)](?=[A-Za-z])"),
    ("double_space", r"(?U)[^\S\n]{2,}"),
    ("empty_parens", r"(?U)\(\s*\)"),
    ("empty_quotes", r"(?U)\"\s*\""),
    ("double_comma", r"(?U),\s*,"),
]
FORBIDDEN_COLLOCATIONS = ["the respective the", "a respective the", "respective the respective", "and and", "of of", "to to", ". .", ",,"]
ARTICLES = ["the", "a", "an"]
PREPOSITIONS = ["to", "of", "in", "for", "on", "at", "by", "with", "from", "into", "under", "over", "within", "between", "among", "against", "before", "after", "about"]
STRUCTURAL_WORDS = ["article", "articles", "clause", "clauses", "section", "sections", "paragraph", "paragraphs", "sub-paragraph", "subparagraph", "sub-paragraphs", "subparagraphs"]

# Words that tell languages apart (language, words); Chinese and Japanese ones count as substrings.
DETECTION_WORDS = [
    ("italian", ["della", "delle", "degli", "che", "e", "nel", "nei", "per", "sono", "sulla", "ai sensi", "deve", "ogni", "presente"]),
    ("dutch", ["het", "de", "en", "van", "dat", "zijn", "deze", "omtrent", "voor", "Partijen", "Overeenkomst", "hierna", "hierbij"]),
    ("german", ["und", "der", "die", "das", "des", "dem", "den", "mit", "im", "zu", "gemäß", "Vertrag", "Parteien"]),
    ("french", ["les", "des", "aux", "du", "que", "et", "une", "dans", "par", "conformément", "lequel"]),
    ("spanish", ["los", "las", "de", "del", "que", "y", "en", "por", "para", "con", "conforme", "mediante"]),
    ("portuguese", ["os", "as", "dos", "das", "que", "e", "em", "por", "para", "conforme", "nos termos"]),
    ("polish", ["w", "na", "z", "do", "że", "i", "się", "oraz", "niniejszy"]),
    ("finnish", ["että", "ja", "sekä", "tämän", "osapuolet", "sopimus"]),
    ("hungarian", ["és", "a", "az", "hogy", "valamint", "Felek", "Szerződés"]),
    ("chinese", ["的", "是", "本", "各方", "协议"]),
    ("japanese", ["の", "は", "に", "を", "本", "契約"]),
]
SUBSTRING_LANGUAGES = ["chinese", "japanese"]

# Words of the source language that should not be left in a translation (language, patterns).
REMNANT_MARKERS = [
    ("italian", ["delle", "degli", "della", "dello", "nelle", "negli", "nella", "nello", "alla", "allo", "alle", "agli", "sulla", "sullo", "sulle", "sugli", "ai sensi", "in conformità", "presente Contratto", "presente contratto", "Committente", "Appaltatore", "Corrispettivo", "Normativa Applicabile", "obbligazioni", "adempimento", "sottoscrizione", "rappresentare", "comunicazioni con", "contestazioni", "predisposizione", "nonché", "laddove", "qualora", "pertanto", "altresì", "fermo restando", r"ivi inclus\w*"]),
    ("dutch", ["Partijen", "Overeenkomst", "hierbij", "hierna", "overkomstig", "overeenkomstig", "hetgeen", "derhalve", "onverminderd", "verplichtingen", "vertegenwoordigd", "Plangebied", "Grondeigenaren", "Windpark", "Stuurgroep", "Projectteam", "grondrechten", "omgevingsvergunning", "concessieverlener", "opzegging", "ontbinding", "ingebrekestelling", "faillissement", "surs[eé]ance", "uit hoofde van", "voor zover", "ten deze", "te dezen", "bestuurder", "vennootschap", "artikel [0-9]+"]),
    ("german", ["gemäß", "hinsichtlich", "dergestalt", "mithin", "sofern", r"vorliegend\w*", r"Vertragspartei\w*", "verpflichtet sich", "Vertragsgegenstand", r"Geschäftsführer\w*", r"Prokurist\w*", r"Bevollmächtigt\w*", "im Rahmen", "gegenüber", "des Weiteren", "Abschluss", "Unternehmen", "Ausübung", "Vertragsschluss"]),
    ("french", ["lequel", "laquelle", "lesquels", "lesquelles", "conformément", "toutefois", "néanmoins", "aux termes", "en vertu", "ledit", "ladite", "lesdits", "lesdites", "dûment", "habilité", "habilitée", "étant entendu", "étant précisé", "Représentant Légal", "Société", "convention", "chacune des parties"]),
    ("spanish", ["conforme a", "en virtud de", "asimismo", "no obstante", "dicho", "dicha", "dichos", "dichas", "mediante", "aquél", "aquélla", "la sociedad", "el presente", "a efectos de", "Consejero Delegado", "Apoderado"]),
    ("portuguese", ["em virtude", "conforme", "outrossim", "nos termos", "mediante", "o presente", "a presente", "Presidente do Conselho", r"Administrador\w*", "Sociedade", "fica acordado"]),
    ("polish", ["niniejszy", "niniejsza", "niniejszej", "niniejszym", "oraz", "zgodnie z", "w szczególności", "Strony", "Umowa", "Spółka", "Prezes Zarządu", "Członek Zarządu", "Pełnomocnik"]),
    ("finnish", ["että", "sekä", "kuitenkin", "sopimus", "osapuolet", "tämän", "Toimitusjohtaja", "Hallituksen puheenjohtaja"]),
    ("hungarian", ["valamint", "továbbá", "illetve", "szerint", "alapján", "vonatkozóan", "Felek", "Szerződés", "a jelen Szerződés", "Ügyvezető", "Vezérigazgató"]),
    ("chinese", ["协议", "各方", "甲方", "乙方", "本协议", "根据", "鉴于", "董事长", "法定代表人", "授权代表"]),
    ("japanese", ["契約", "甲", "乙", "当事者", "本契約", "本書", "代表取締役", "取締役", "支配人", r"(?i)\b(?:Reiwa|Heisei|Showa|Taisho|Meiji)\s+\d"]),
]
ALLOWED_CONTEXTS = ["Banca d'Italia", "Cassa Depositi e Prestiti", "Contratto di Finanziamento"]

# Phrases that a translation should not hold (severity, pattern, language or * for all).
FORBIDDEN_PHRASES = [
    ("BLOCK", r"\bthe present (?:agreement|contract|deed)\b", "*"),
    ("BLOCK", r"\bthis present (?:agreement|contract|deed)\b", "*"),
    ("BLOCK", r"\bauthenticating signature\b", "*"),
    ("BLOCK", r"\brepresentative acting on behalf of the\b", "*"),
    ("BLOCK", r"\bduly invested with (?:the )?(?:necessary )?powers?\b", "*"),
    ("BLOCK", r"\bendowed with (?:the )?necessary powers?\b", "*"),
    ("BLOCK", r"\bon the basis of and pursuant to\b", "*"),
    ("BLOCK", r"\bbearing the date of\b", "*"),
    ("BLOCK", r"\bin the name and on behalf of\b", "*"),
    ("BLOCK", r"\b(?:plants|receivables|assets) existing and future\b", "*"),
    ("BLOCK", r"\bapplicant organisation:\s*$", "*"),
    ("BLOCK", r"\bfor the grant application entitled\b", "*"),
    ("BLOCK", r"(?m)^\s*(?:Position|Function|Capacity|Role)\s*:\s*[A-Z]", "*"),
    ("WARN", r"\bArticle\s+\d+(?:\.\d+)*\b(?![\:\.]\d)(?!\s*(?:of the|of Book|BW|of Directive|of Regulation|of the EU|of the European|of Law))", "*"),
    ("BLOCK", r"\bframework conditions?\b", "dutch"),
    ("BLOCK", r"\bin more concrete terms\b", "dutch"),
    ("BLOCK", r"\benvirons fund\b", "dutch"),
    ("BLOCK", r"\bacceptance by the environs\b", "dutch"),
    ("BLOCK", r"\bwind park\b", "dutch"),
    ("BLOCK", r"\bsun park\b", "dutch"),
    ("BLOCK", r"\bground rights\b", "dutch"),
    ("BLOCK", r"\bground owners?\b", "dutch"),
    ("BLOCK", r"\bnet connection\b", "dutch"),
    ("BLOCK", r"\bbehaviour code\b", "dutch"),
    ("BLOCK", r"\bstriking shadow\b", "dutch"),
    ("BLOCK", r"\bsupport base\b", "dutch"),
    ("BLOCK", r"\blandscape insertion\b", "dutch"),
    ("BLOCK", r"\bgroup society\b", "dutch"),
    ("BLOCK", r"\b(?:statutorily|legally) (?:established|domiciled) at\b", "dutch"),
    ("BLOCK", r"\blegally validly represented\b", "dutch"),
    ("BLOCK", r"\bputting in default\b", "dutch"),
    ("BLOCK", r"\bsuspensive conditions?\b", "dutch"),
    ("BLOCK", r"\bresolutive conditions?\b", "dutch"),
    ("BLOCK", r"\bsolidarily liable\b", "dutch"),
    ("BLOCK", r"\bintent or gross fault\b", "dutch"),
    ("BLOCK", r"\bequivalent partner\b", "dutch"),
    ("BLOCK", r"\bconcurrent activities\b", "dutch"),
    ("BLOCK", r"\bapproach plan\b", "dutch"),
    ("WARN", r"\bcooperation on an equal footing\b", "dutch"),
    ("BLOCK", r"\blegislative changes\b(?!\s+(?:and|or))", "italian"),
    ("BLOCK", r"\bfinancing institutions?\b", "italian"),
    ("BLOCK", r"\bpenalties for delay\b", "italian"),
    ("BLOCK", r"\bdefinitive project\b", "italian"),
    ("BLOCK", r"\bexecutive project\b", "italian"),
    ("BLOCK", r"(?m)^\s*(?:Clause\s+\d+\.?\s+)?Notification\s*$", "spanish"),
    ("BLOCK", r"(?m)^\s*(?:Clause\s+\d+\.?\s+)?Communication\s*$", "spanish"),
    ("BLOCK", r"\bSpanish\s+common\s+law\b", "spanish"),
    ("BLOCK", r"(?m)^\s*RECITE\s*$", "spanish"),
    ("BLOCK", r"\bfor\s+a\s+single\s+effect\b", "spanish"),
    ("WARN", r"\bshall\s+be\s+endeavoured\s+to\s+be\b", "spanish"),
]
# Terms, legislation words and last words of the quality checks.
TERM_VIOLATIONS = ["Financing Agreement", "Financing Bank", "Business Register", "Lien Assets", "Partial Invalidity", "cash line", "Cash line", "revolving line", "credit lines", "credit line", "Domicile Election", "election of domicile", "Election of Domicile", "which intervenes as", "who intervenes as", "intervenes as", "by universal or singular title", "Deed of Establishment", "Deed of Creation", "deed of creation", "Deed of Constitution of Pledge", "deed of constitution", "plants and works existing and future", "Description of Financing", "stipulated"]
LEGISLATION_WORDS = ["Civil Code", "Legislative Decree", "D.P.R.", "Law No.", "Law no.", "Royal Decree", "Ministerial Decree", "Regulation (EU)", "Banking Act", "decreto legislativo", "Codice Civile", "D.Lgs.", "D.L.", "T.U.B.", "T.U.F.", "Decree No.", "Decree no.", "Consolidated Banking", "Consolidated Financial", "Presidential Decree"]
FORBIDDEN_TITLES = ["Deed of Establishment of Special Lien", "DEED OF ESTABLISHMENT OF SPECIAL LIEN", "Deed of Creation of Mortgage", "DEED OF CREATION OF MORTGAGE", "Deed of Constitution of Pledge", "DEED OF CONSTITUTION OF PLEDGE", "deed of creation of the Pledge", "deed of creation of the pledge", "deed of constitution of the pledge"]
PLACEHOLDERS = ["PM", "[PM]", "TBD", "[TBD]", "TBC", "[TBC]", "[...]", "[…]", "[●]", "[•]"]
ABBREVIATIONS = ["No.", "no.", "etc.", "art.", "S.p.A.", "S.r.l.", "..", "seq."]
LAST_WORDS = ["the", "of", "and", "in", "to", "for", "with", "by", "from", "or", "as", "at", "on", "that", "which", "under", "pursuant", "without", "any", "each", "such", "this", "shall", "will", "may", "a", "an"]
# Spellings (US, UK).
SPELLINGS = [
    ("authorize", "authorise"), ("authorized", "authorised"), ("Authorized", "Authorised"), ("AUTHORIZATION", "AUTHORISATION"), ("Authorization", "Authorisation"), ("authorization", "authorisation"), ("recognize", "recognise"), ("recognized", "recognised"),
    ("organize", "organise"), ("organized", "organised"), ("organization", "organisation"), ("favor", "favour"), ("favored", "favoured"), ("favorable", "favourable"), ("honor", "honour"), ("honored", "honoured"), ("center", "centre"), ("defense", "defence"),
    ("offense", "offence"), ("fulfill", "fulfil"), ("fulfillment", "fulfilment"), ("judgment", "judgement"), ("judgments", "judgements"), ("Judgment", "Judgement"), ("acknowledgment", "acknowledgement"), ("acknowledgments", "acknowledgements"), ("utilize", "utilise"),
    ("utilized", "utilised"), ("utilization", "utilisation"), ("canceled", "cancelled"), ("canceling", "cancelling"), ("labor", "labour"), ("analyze", "analyse"), ("analyzed", "analysed"),
]
# Further spellings (US, UK) of the wide tables.
WIDE_SPELLINGS = [
    ("plow", "plough"), ("plows", "ploughs"), ("plowing", "ploughing"), ("plowings", "ploughings"), ("plowed", "ploughed"), ("Plow", "Plough"), ("Plowing", "Ploughing"), ("Plowings", "Ploughings"), ("aluminum", "aluminium"), ("Aluminum", "Aluminium"),
    ("maneuver", "manoeuvre"), ("maneuvers", "manoeuvres"), ("maneuvered", "manoeuvred"), ("maneuvering", "manoeuvring"), ("Maneuver", "Manoeuvre"), ("mold", "mould"), ("molds", "moulds"), ("molded", "moulded"), ("Mold", "Mould"),
    ("skeptic", "sceptic"), ("skeptical", "sceptical"), ("skepticism", "scepticism"), ("Skepticism", "Scepticism"),
]
# UK spellings that become US ones, but not the other way round, in the wide tables (UK, US).
TO_US_ONLY = [
    ("whilst", "while"), ("Whilst", "While"), ("amongst", "among"), ("Amongst", "Among"), ("learnt", "learned"), ("Learnt", "Learned"), ("spelt", "spelled"), ("Spelt", "Spelled"), ("dreamt", "dreamed"), ("Dreamt", "Dreamed"), ("burnt", "burned"), ("Burnt", "Burned"), ("spoilt", "spoiled"), ("Spoilt", "Spoiled"),
    ("kerb", "curb"), ("kerbs", "curbs"), ("Kerb", "Curb"), ("tyre", "tire"), ("tyres", "tires"), ("Tyre", "Tire"), ("cheque", "check"), ("cheques", "checks"), ("Cheque", "Check"), ("Cheques", "Checks"), ("storey", "story"), ("storeys", "stories"), ("Storey", "Story"),
    ("enquire", "inquire"), ("enquiry", "inquiry"), ("enquiries", "inquiries"), ("Enquire", "Inquire"), ("Enquiry", "Inquiry"), ("ageing", "aging"), ("Ageing", "Aging"),
]
# US spellings that passes rewrite but checks don't report.
UNCHECKED_SPELLINGS = ["Authorized", "favored", "favorable", "honored", "offense", "acknowledgments", "utilization", "canceling", "labor", "analyzed"]
# Literal replacements of terms, applied top to bottom before the patterns.
TERM_LITERALS = [
    ("Financing Agreement", "Facility Agreement"),
    ("Financing Bank", "Lender"),
    ("Description of Financing", "Description of the Facility"),
    ("Description of the Financing", "Description of the Facility"),
    ("BANKING TRANSPARENCY", "TRANSPARENCY OF BANKING CONDITIONS"),
    ("Banking Transparency", "Transparency of Banking Conditions"),
    ("banking transparency", "transparency of banking conditions"),
    ("Domicile Election", "Service of Process"),
    ("DOMICILE ELECTION", "SERVICE OF PROCESS"),
    ("Election of Domicile", "Service of Process"),
    ("ELECTION OF DOMICILE", "SERVICE OF PROCESS"),
    ("election of domicile", "service of process"),
    ("Partial Invalidity", "Severability"),
    ("PARTIAL INVALIDITY", "SEVERABILITY"),
    ("which intervenes as", "acting as"),
    ("who intervenes as", "acting as"),
    ("intervenes as", "acts as"),
    ("Business Register", "Companies Register"),
    ("Lien Assets", "Secured Assets"),
    ("that precedes", "above"),
    ("that precede,", "above,"),
    ("that precede ", "above "),
    ("that follows", "below"),
    ("that follow,", "below,"),
    ("that follow ", "below "),
    ("REGISTRATION AND PUBLICITY", "REGISTRATION AND PERFECTION"),
    ("Registration and Publicity", "Registration and Perfection"),
    ("registration and publicity", "registration and perfection"),
    ("TRANSCRIPTION AND PUBLICITY", "REGISTRATION AND PERFECTION"),
    ("Transcription and Publicity", "Registration and Perfection"),
    ("transcription and publicity", "registration and perfection"),
    ("by universal or singular title", "whether by way of universal or individual succession"),
    ("hereby stipulate", "hereby agree"),
    ("hereby Stipulate", "hereby agree"),
    ("the parties stipulate", "the parties agree"),
    ("the Parties stipulate", "the Parties agree"),
    ("to stipulate", "to enter into"),
    ("to Stipulate", "to enter into"),
    ("cash line", "term facility"),
    ("Cash line", "Term facility"),
    ("revolving line", "revolving facility"),
    ("Revolving line", "Revolving facility"),
    ("credit lines", "credit facilities"),
    ("Credit lines", "Credit facilities"),
    ("credit line", "credit facility"),
    ("Credit line", "Credit facility"),
    ("DEED OF CONSTITUTION OF PLEDGE", "DEED OF PLEDGE"),
    ("Deed of Constitution of Pledge", "Deed of Pledge"),
    ("deed of constitution of pledge", "deed of pledge"),
    ("deed of constitution of the pledge", "deed of pledge"),
    ("Deed of constitution of the Pledge", "Deed of Pledge"),
    ("deed of creation of the pledge", "deed of pledge of quotas"),
    ("deed of creation of the Pledge", "Deed of Pledge of Quotas"),
    ("Deed of Establishment of Special Lien", "Deed of Special Lien"),
    ("DEED OF ESTABLISHMENT OF SPECIAL LIEN", "DEED OF SPECIAL LIEN"),
    ("Deed of establishment of special lien", "Deed of Special Lien"),
    ("Deed of Creation of Mortgage", "Deed of Mortgage"),
    ("DEED OF CREATION OF MORTGAGE", "DEED OF MORTGAGE"),
    ("deed of creation of mortgage", "deed of mortgage"),
    ("Deed of Establishment of Mortgage", "Deed of Mortgage"),
    ("DEED OF ESTABLISHMENT OF MORTGAGE", "DEED OF MORTGAGE"),
    ("“Parti”", "“Parties”"),
    ('"Parti"', '"Parties"'),
    ("“Parte”", "“Party”"),
    ('"Parte"', '"Party"'),
    ("cinquanta per cento", "fifty per cent"),
]
# Replacements of terms by pattern, applied top to bottom.
TERM_REPLACEMENTS = [
    (r"(?<!Project )\bFinancing\b(?! Bank)", "Facility"),
    (r"\b(plants?\s+and\s+works?|assets?|receivables?|goods?|works?|rights?|obligations?|claims?|credits?|sums?)\s+existing\s+and\s+future\b", "existing and future $1"),
    (r"\bciascun[ao]?\b", "each"),
]
ANNEX_EXCLUDE = ["Regulation", "Directive", "Law", "Decree", "Regolamento"]
DEFINITION_VERBS = ["means", "shall mean", "has the meaning", "indicates"]
# Parts of the document itself, words that point within it, and what makes a name one of the document's own.
INTERNAL_ANCHORS = ["Schedule", "Schedules", "Annex", "Annexes", "Annexure", "Annexures", "Attachment", "Attachments", "Appendix", "Appendices", "Appendixes", "Exhibit", "Exhibits", "Section", "Sections", "Paragraph", "Paragraphs", "Subparagraph", "Subparagraphs", "Clause", "Clauses", "Article", "Articles", "Chapter", "Chapters", "Part", "Parts"]
INTERNAL_LOCATORS = ["above", "below", "hereof", "hereto", "herein", "hereinafter", "hereinabove", "hereinbelow", "hereunder", "foregoing", "preceding", "following", "said"]
INTERNAL_DETERMINERS = ["this", "the present", "the said", "this same", "that precedes", "that follows", "the foregoing", "the preceding", "the following"]
# Bold words before a colon that define no term, whole and as beginnings; what no term holds.
BOLD_NO_TERMS = [
    "subject", "re", "from", "to", "date", "sent", "cc", "bcc", "whereas", "now therefore", "now, therefore", "witnesseth", "in witness whereof", "attention", "attn", "address", "fax", "tel", "telephone", "phone", "email", "e-mail", "pec",
    "oggetto", "premesso", "considerato", "visto", "tanto premesso", "tutto ciò premesso", "ora pertanto", "indirizzo", "all'attenzione", "all’attenzione", "asunto", "assunto", "considerando", "considerandos", "visto que",
    "objet", "attendu", "attendu que", "considérant", "betreff", "erwägung", "in erwägung", "onderwerp", "overwegende", "aangezien", "temat", "zważywszy", "mając na uwadze", "tárgy", "mivel", "tekintettel arra", "aihe", "ottaen huomioon", "koska",
]
BOLD_NO_TERM_STARTS = ["if to ", "with copy to ", "se a ", "in caso di "]
NO_TERM_PARTS = ['"', "“", "”", "«", "»", " means", " shall mean", " has the meaning", " is defined as"]
HEADING_STYLES = ["heading", "fwbl", "legance title", "titulo", "titolo", "clausola", "articolo"]
# Marks that stand between two revisions without parting them.
TRANSPARENT_MARKS = ["commentRangeStart", "commentRangeEnd", "bookmarkStart", "bookmarkEnd", "proofErr"]


def word_pattern(word: str) -> str:
    return rf"(?iU)\b{word}\b"


def remnant_rules(spark: SparkSession) -> DataFrame:
    """(language, marker, pattern) of the remnant markers."""
    rows = [(lang, w, w if lang in SUBSTRING_LANGUAGES else rf"(?iU)\b{w}\b") for lang, words in REMNANT_MARKERS for w in words]
    return spark.createDataFrame(rows, "language string, marker string, pattern string")


def phrase_rules(spark: SparkSession) -> DataFrame:
    """(seq, severity, pattern, language) of the forbidden phrases."""
    rows = [(k, s, f"(?iU){p}", lang) for k, (s, p, lang) in enumerate(FORBIDDEN_PHRASES)]
    return spark.createDataFrame(rows, "seq int, severity string, pattern string, language string")
