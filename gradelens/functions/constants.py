"""Fixed values that must equal the reference's for the results to agree.

Everything below is stated as data, in the reference's natural order.
"""

# --- fixed values: targets and threshold -----------------------------------
TARGET_REG = "note_moyenne"
TARGET_CLF = "reussite"
PASS_THRESHOLD = 10.0

# --- fixed values: identity columns excluded from modelling ----------------
ID_COLUMNS = [
    "nom", "prenom", "adresse", "etablissement", "nom_plateforme",
    "autre_etat_psy", "specialite1ere_1_nom", "specialite1ere_2_nom",
    "specialite1ere_3_nom", "specialiteterm_1_nom", "specialiteterm_2_nom",
    "soutien_matieres", "etat_psychologique",
]

# --- fixed values: grade columns (row mean, subject models) ----------------
GRADE_COLUMNS = [
    "note_francais", "note_maths", "note_histoire_geo", "note_sciences",
    "note_specialite1ere_1", "note_specialite1ere_2", "note_specialite1ere_3",
    "note_specialiteterm_1", "note_specialiteterm_2",
]

CLOCK_COLUMNS = ["heure_coucher", "heure_lever"]

# Columns dropped before modelling: identity + grades + raw clocks.
COLS_TO_DROP = ID_COLUMNS + GRADE_COLUMNS + CLOCK_COLUMNS

# --- fixed values: identity columns of uploaded data (case-insensitive) ----
UPLOAD_ID_COLUMNS = ["id", "nom", "prenom", "prénom", "adresse", "mail"]

# --- fixed values: columns beside batch predictions (case-insensitive) ------
PREDICTION_ID_COLUMNS = ["nom", "prenom", "prénom", "id", "mail"]

# --- fixed values: columns hidden from profiles (case-insensitive) ----------
PROFILE_HIDDEN_COLUMNS = ["nom", "prenom", "prénom", "prenoms", "prénoms",
                          "adresse", "id", "mail"]

# --- fixed values: concept keywords, searched in this order ----------------
KEYWORDS = {
    "sport": ["sport", "activite_sportive", "activite_sport", "physique"],
    "jeux_video": ["jeux_video", "gaming", "video_games", "manette"],
    "reseaux": ["reseaux", "social", "instagram", "tiktok", "facebook", "snapchat"],
    "streaming": ["streaming", "netflix", "youtube", "disney", "video"],
    "sommeil": ["sommeil", "dodo", "sleep", "repos"],
    "etude": ["etude", "devoirs", "travail", "study", "soir"],
    "stress": ["stress", "anxiete", "pression", "personnel"],
    "motivation": ["motivation", "interet", "envie", "engagement"],
    "note_moyenne": ["moyenne", "note_moyenne", "grade_avg", "resultat"],
    "heure_coucher": ["coucher", "bedtime", "sleep_at"],
    "heure_lever": ["lever", "wakeup", "wake_up"],
}

# --- fixed values: text read as "yes" by the sport flag (lower-cased) -------
TRUTHY_TEXT = ["oui", "yes", "1", "true"]

# --- fixed values: words of motivation columns (substring match) ------------
MOTIVATION_WORDS = ["interet", "motivation"]

# --- fixed values: defaults when a concept has no column --------------------
DEFAULT_SLEEP_HOURS = 8.0
DEFAULT_STUDY_HOURS = 2.0
DEFAULT_MOTIVATION = 5.0

# --- fixed values: readable feature labels ---------------------------------
TRANSLATIONS = {
    "heures_etude_soir": "Heures d'étude (soir)",
    "interet_maths": "Intérêt pour les Maths",
    "heures_sommeil": "Heures de sommeil",
    "stress_personnel": "Niveau de stress personnel",
    "perseverance": "Persévérance",
    "absences": "Nombre d'absences",
    "heures_jeux_video": "Jeux Vidéo",
    "score_equilibre": "Équilibre Vie/Études",
    "stress_total": "Stress Total",
    "genre_m": "Genre : Garçon",
    "genre_f": "Genre : Fille",
    "activite_sportive_oui": "Pratique du sport",
    "activite_sportive_non": "Pas de sport",
    "temps_ecrans_total": "Temps d'écran total",
    "ratio_etude_ecrans": "Ratio Étude/Écrans",
    "indice_motivation": "Indice de Motivation",
    "organisation": "Capacité d'organisation",
    "confiance_soi": "Confiance en soi",
    "estime_soi": "Estime de soi",
}

# --- fixed values: class names to codes ------------------------------------
CLASS_CODES = {
    "Sixième": "6eme", "Cinquième": "5eme", "Quatrième": "4eme",
    "Troisième": "3eme", "Seconde": "2nde", "Première": "1ere",
    "Terminale": "terminale",
}

# --- fixed values: linear grade score (weights of the deterministic signal) -
SCORE_WEIGHTS = {
    "heures_etude_soir": 1.5,
    "interet_maths": 0.4,
    "interet_francais": 0.4,
    "heures_jeux_video": -0.8,
    "heures_reseaux_sociaux": -0.8,
    "stress_personnel": -1.0,
    "heures_sommeil": 0.3,
    "organisation": 0.2,
    "perseverance": 0.5,
}
SCORE_SPORT_BONUS = 1.0          # activite_sportive == 'oui'
SCORE_COMMUTE_PENALTY = -1.0     # duree_trajet_ar_min > 60
SCORE_COMMUTE_LIMIT = 60
SCORE_CENTRE = 7.5
SUBJECT_BASES = {"note_francais": 11.0, "note_maths": 10.0,
                 "note_histoire_geo": 12.0, "note_sciences": 11.0}
SPECIALTY_BASE = 12.0
GRADE_MIN, GRADE_MAX = 0.0, 20.0

# --- fixed values: prediction bands ----------------------------------------
BAND_GREEN_FROM = 14.0
BAND_ORANGE_FROM = 10.0

# At-risk rule from the report's advice: pass probability < 60 % or note < 10.
AT_RISK_PROBA = 60.0

# --- fixed values: model search spaces -------------------------------------
SPLIT_TEST_FRACTION = 0.2
SEED = 42
CV_FOLDS = 3
SEARCH_CANDIDATES = 10
SELECTOR_TREES = 50
SELECTOR_FACTOR = 0.5

GBT_GRID = {"maxIter": [50, 100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.2]}
RF_GRID = {"numTrees": [100, 200], "maxDepth": [5, 10, None], "minSamplesSplit": [2, 5]}
MLP_GRID = {"hidden": [(64, 32), (128, 64), (100,)], "activation": ["relu", "tanh"],
            "learningRate": [0.001, 0.01]}
SVR_GRID = {"C": [0.1, 1, 10], "epsilon": [0.01, 0.1, 0.5], "kernel": ["rbf", "poly"]}
SVC_GRID = {"C": [0.1, 1, 10], "kernel": ["rbf", "linear"]}

# Display names of the model families in reports (this library's own wording, not a reference value).
FAMILY_NAMES = {"gbt_reg": "Boosted trees", "rf_clf": "Random forest", "mlp_reg": "Neural network",
                "mlp_clf": "Neural network", "svr": "SVM (SVR)", "svc": "SVM (SVC)"}
