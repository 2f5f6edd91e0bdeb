import pytest
from pyspark.sql import functions as F

from wardenlake.llm import language, pairs
from wardenlake.llm.queries import _labelled
from wardenlake.sources.tables import table

SF = "/root/testdata/sf0.01"
Q = "How many retries did Thistle-11 need for task 9065?"
A = "It needed 31 retries. The first ones failed because shelfscan was not reachable at that time."
CASES = [
    (Q, A, []), (Q, "It needed 31 retries.", []), (Q, A.rstrip(".").lower(), []), (Q, None, ["empty"]), (Q, "<p></p>", ["empty"]), (Q, " ​- ", ["empty"]), (Q, "null", ["empty"]), (Q, "Short answer first.", ["empty"]),
    (Q, Q, ["copy"]), (Q, "You asked: " + Q, ["copy"]), (Q, Q + "\n" + Q, ["copy"]), (Q, Q[4:], ["copy"]), (Q, Q + " " + A, []), ("Repeat this sentence word for word: " + A, A, []),
    (Q, "I'm sorry, but I can't help with that.", ["refusal"]), (Q, "I cannot see any failed step in the trace, so the run counts as clean.", []), (Q, "The agent refused the request, since the caller had no access.", []),
    (Q, "Leider bin ich nicht befugt, darüber Auskunft zu geben.", ["refusal", "language"]), (Q, A[:60], ["truncated"]), (Q, A[:58] + " …", ["truncated"]),
    ("Return a JSON object with agent, tool and calls for run 4.", '{"agent": "Sable-1", "tool": "pin', ["truncated"]), ("Return a JSON object with agent, tool and calls for run 4.", '{"agent": "Sable-1", "tool": "pinboard", "calls": 9}', []),
    (Q, "Es waren 54 Wiederholungen nötig. Die ersten scheiterten, weil tracegrep damals nicht erreichbar war.", ["language"]),
    (Q + " Antworte auf Deutsch.", "Es waren 54 Wiederholungen nötig. Die ersten scheiterten, weil tracegrep damals nicht erreichbar war.", []),
    ("Yes or no: did Vesper-24 finish task 8766?", "No", []), ("Yes or no: did Vesper-24 finish task 8766?", "Ja.", ["language"]), ("Give only the number: how many calls did ledgerctl get in run 3119?", "39", []),
]


@pytest.fixture(scope="module")
def known(spark):
    evals = table(spark, SF, "evals")
    sample = pairs.sample_pairs(evals, "seq", "input", "output", "expected")
    return pairs.adapted(spark, _labelled(spark, SF), sample), pairs.fit_endings(sample)


@pytest.mark.parametrize(("prompt", "response", "want"), CASES)
def test_defects(known, prompt, response, want):
    assert pairs.defects_of([prompt], [response], *known)[0] == want


def test_rows(spark, known):
    rows = [(1, Q, None), (2, None, A), (3, "", A), (4, Q, "It needed 31 retries. " * 5000), (1, Q, None), (None, Q, "")]
    df = spark.createDataFrame(rows, "seq bigint, input string, output string").withColumn("defect", F.lit(0))
    got = pairs.find_defects(df, "seq", "input", "output", *known)
    assert sorted(map(str, got.collect())) == sorted(["Row(seq=1, defect='empty')"] * 2 + ["Row(seq=None, defect='empty')"])
    assert pairs.find_defects(df.limit(0), "seq", "input", "output", *known).count() == 0
    none = spark.createDataFrame([], "seq bigint, input string, output string, expected string")
    sample = pairs.sample_pairs(none, "seq", "input", "output", "expected")
    model, _ = pairs.adapted(spark, [("the run stopped", "en")], sample)
    assert model.languages == ["en"]
    assert pairs.fit_endings(sample).bits(["x"]).shape == (1,)


ITALIAN = "Sono stati necessari 31 tentativi. I primi sono falliti perché shelfscan non era raggiungibile in quel momento."
DUTCH = "Er waren 31 pogingen nodig. De eerste mislukten omdat de dienst op dat moment niet bereikbaar was."


@pytest.mark.parametrize(
    ("prompt", "response", "want"),
    [("¿Cuántos reintentos necesitó Thistle-11 para la tarea 9065?", ITALIAN, ["language"]), (Q + " Please answer in Italian.", ITALIAN, []), ("Wie viele Versuche brauchte Thistle-11 für Aufgabe 9065?", DUTCH, ["language"]), (Q + " Answer in Dutch.", DUTCH, [])],
)
def test_languages_that_prompts_do_not_use(known, prompt, response, want):
    assert pairs.defects_of([prompt], [response], *known)[0] == want


#: Refusals that no table of tests holds; the dictionaries were completed with the first ones, the others were kept for measuring.
SEEN = ["I'm sorry, but I can't help with that request.", 'I am unable to provide this information.', "Unfortunately that is something I'm not permitted to share.", 'I have to turn this down.', 'As an AI model, I cannot give legal advice.', "That's not a question I can answer.", 'My guidelines do not allow me to discuss it.', "I won't answer this.", 'We regret that we cannot fulfil this request.', "I'd prefer not to comment on that.", 'This request goes against our policy.', "I don't think I should answer that.", 'No comment.', 'I must respectfully decline.', 'Es tut mir leid, dabei kann ich nicht helfen.', 'Diese Frage möchte ich nicht beantworten.', 'Dazu darf ich keine Auskunft geben.', 'Ich bin nicht berechtigt, darüber zu sprechen.', 'Das lehne ich ab.', 'Meine Richtlinien erlauben mir das nicht.', 'Ich kann Ihnen diese Information leider nicht geben.', 'Darüber möchte ich nicht sprechen.', 'Hierzu kann ich mich nicht äußern.', 'Ihre Anfrage muss ich zurückweisen.', 'Je suis désolé, je ne peux pas vous aider.', "Il m'est impossible de répondre à cette question.", 'Je refuse de répondre.', "Je n'ai pas le droit de communiquer cette information.", "Cela va à l'encontre de mes règles.", 'Je préfère ne rien dire à ce sujet.', "Mes consignes ne me permettent pas d'en parler.", 'Je ne saurais répondre à cela.', 'Je regrette, mais je dois refuser.', 'Je ne suis pas en mesure de fournir cela.', 'Lo siento, no puedo ayudarte con eso.', 'No me es posible contestar a esa pregunta.', 'Me niego a responder.', 'No estoy autorizado para compartir esos datos.', 'Eso va en contra de mis normas.', 'Prefiero no hablar de eso.', 'Mis reglas no me permiten decirlo.', 'Tengo que rechazar esta petición.', 'No voy a responder a eso.', 'Lamentablemente no puedo facilitar esa información.']
UNSEEN = ["Sorry, I can't assist with that.", "I'm afraid I cannot comply with this request.", 'I would prefer not to discuss internal matters.', 'Our policies forbid sharing such details.', "I'm not going to answer that question.", "That is outside what I'm allowed to talk about.", 'I must refuse to answer.', 'We are unable to help you here.', 'Leider kann ich darauf nicht antworten.', 'Ich werde diese Daten nicht weitergeben.', 'Das darf ich Ihnen nicht verraten.', 'Ich muss diese Anfrage ablehnen.', 'Unsere Regeln untersagen eine Antwort.', 'Bedaure, dabei helfe ich nicht.', 'Désolé, je ne peux pas répondre.', 'Je dois décliner votre demande.', 'Nos règles interdisent de partager ces données.', 'Je ne souhaite pas commenter ce point.', 'Cette question dépasse mes autorisations.', "Il ne m'est pas permis d'en dire plus.", 'Lo lamento, pero no puedo compartir eso.', 'No tengo permiso para responder.', 'Nuestras normas prohíben dar esa información.', 'Debo declinar la solicitud.', 'Prefiero no comentar ese asunto.', 'Eso no lo puedo contestar.']
NO_REFUSALS = ['The agent cannot write to the store because the rule forbids it.', 'I checked the trace and the run stopped after 40 steps.', 'The firewall refused the request because it matched a blocked pattern.', 'Der Lauf wurde abgelehnt, weil die Regel verletzt war.', 'Ich habe den Bericht gelesen und alles stimmt.', "La règle interdit l'accès à la mémoire, donc la demande a été refusée.", 'No se puede borrar la memoria sin permiso, según la regla 12.', 'El agente rechazó la petición porque superaba el límite.', "You can't help but notice that latency doubled.", 'I can answer that: the cache is cleared every night.', 'The tool is not able to parse dates before 1970.', 'Je peux vous aider: videz le cache puis relancez.', "It won't restart on its own, so run the job again.", 'Das Werkzeug kann keine leeren Zeilen lesen.']
NO_ANSWERS = ["...", "—", "N/A", "(no answer)", "[answer here]", "<answer>", "lorem ipsum", "TBD", "Answer:", "Here's the answer:", "Sure thing!", "Let me explain.", "Klar, hier ist die Antwort:", "Voici ma réponse :", "Aquí tienes la respuesta:", "[Antwort einfügen]", "keine Angabe", "sans objet", "sin respuesta", "null\n", "{}", '""', "n.a.", "to be completed"]


def test_dictionaries():
    assert all(map(pairs.is_refusal, SEEN)) and not any(map(pairs.is_refusal, NO_REFUSALS))
    assert sum(map(pairs.is_refusal, UNSEEN)) >= 0.8 * len(UNSEEN)
    assert all(map(pairs.is_empty, NO_ANSWERS)) and not any(map(pairs.is_empty, ["No.", "42", "[1, 2]", "(see rule 12)", "Here is the answer: 42 steps.", *NO_REFUSALS]))


def test_recall_by_defect(spark, known):
    """Defects put into good answers: references that the models were not fitted on, as texts of their own."""
    (model, script), endings = known
    rows = [r for r in table(spark, "/root/testdata/sf0.1", "evals").select("input", "expected").filter("expected IS NOT NULL AND length(expected) > 60").orderBy(F.desc("seq")).limit(600).collect()]
    langs = [(language.segments_of([r.input], model, script)[0] or [{"lang": None}])[0]["lang"] for r in rows]
    good = [(r.input, r.expected) for r in rows]

    def share(made, defect):
        found = pairs.defects_of([p for p, _ in made], [a for _, a in made], (model, script), endings)
        return sum(defect in d for d in found) / len(made), sum(bool(d) for d in found) / len(made)

    swapped = [(p, good[(i + 1) % len(good)][1]) for i, (p, _) in enumerate(good) if langs[i] and langs[(i + 1) % len(good)] and langs[i] != langs[(i + 1) % len(good)]]
    recall = {
        "truncated": share([(p, a[: len(a) * 2 // 3].rpartition(" ")[0]) for p, a in good], "truncated")[0],
        "copy": share([(p, p.upper() if i % 2 else f"> {p}") for i, (p, _) in enumerate(good)], "copy")[0],
        "language": share(swapped, "language")[0],
        "empty": share([(p, NO_ANSWERS[i % len(NO_ANSWERS)]) for i, (p, _) in enumerate(good)], "empty")[0],
        "refusal": share([(p, UNSEEN[i % len(UNSEEN)]) for i, (p, _) in enumerate(good)], "refusal")[0],
    }
    wrong = share(good, "")[1]
    print("recall by defect", {k: round(v, 3) for k, v in recall.items()}, "good answers flagged", round(wrong, 3))
    assert min(recall.values()) >= 0.8 and wrong <= 0.05
