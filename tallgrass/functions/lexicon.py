"""Word and phrase lists of the prose transforms. They decide results, so they are stated as text."""

# fixed values: openers that carry no content (regex fragments, case-insensitive)
OPENERS = (
    "I'd be happy to help you with that[!.?,]?",
    "I'd be happy to help with that[!.?,]?",
    "I would be happy to help you with that[!.?,]?",
    "I would be happy to help with that[!.?,]?",
    "I'm happy to help you with that[!.?,]?",
    "I am happy to help you with that[!.?,]?",
    "You're absolutely right[!.?,]?",
    "You make a great point[!.?,]?",
    "That's a great question[!.?,]?",
    "That's a good question[!.?,]?",
    "That's a great point[!.?,]?",
    "Excellent question[!.?,]?",
    "I'd be happy to help[!.?,]?",
    "I would be happy to help[!.?,]?",
    "I'm happy to help[!.?,]?",
    "I am happy to help[!.?,]?",
    "Sure,? I can help[!.?,]?",
    "Sure,? I'd be glad to[!.?,]?",
    "Great question[!.?,]?",
    "Good question[!.?,]?",
    "You're right[!.?,]?",
    "That's right[!.?,]?",
    "That's correct[!.?,]?",
    "Great point[!.?,]?",
    "Good point[!.?,]?",
    "Of course[!,.?]?",
    "Absolutely[!,.?]?",
    "Certainly[!,.?]?",
    "Sure[!,.?]?",
)
# fixed values: phrases that are struck out
STRIKE = (
    "in conclusion,?",
    "to summarize,?",
    "in summary,?",
    "first and foremost,?",
    "last but not least,?",
    "it is important to note that",
    "it's important to note that",
    "it is worth noting that",
    "it's worth noting that",
    "it should be noted that",
    "it must be noted that",
    "needless to say,?",
    "it goes without saying,?",
    "at the end of the day,?",
    "as previously mentioned,?",
    "as mentioned earlier,?",
    "as mentioned above,?",
    "as mentioned before,?",
    "in the realm of",
    "in today's fast-paced world,?",
    "in this day and age,?",
    "in the world of",
    "in this article,?",
    "in this post,?",
    "in this tutorial,?",
    "in this guide,?",
    "in this section,?",
    "in this blog post,?",
    "navigate the complexities of",
    "embark on a journey",
    "embark on the journey",
    "as an AI language model,?",
    "as a large language model,?",
    "as an AI,?",
    "being an AI,?",
    "I hope this helps[!.]?",
    "I hope this answers your question[!.]?",
    "I hope that helps[!.]?",
    "feel free to ask[!.]?",
    "feel free to ask any other questions[!.]?",
    "please let me know if you have any questions[!.]?",
    "please let me know if you need anything else[!.]?",
    "let's dive in[!.]?",
    "let us dive in[!.]?",
    "let's dive deep[!.]?",
    "let's get started[!.]?",
)
# fixed values: phrase and replacement
PHRASES = (
    ("in order to", "to"),
    ("due to the fact that", "because"),
    ("at this point in time", "now"),
    ("at this moment in time", "now"),
    ("a number of", "several"),
    ("a large number of", "many"),
    ("a small number of", "few"),
    ("the majority of", "most"),
    ("with regard to", "about"),
    ("with regards to", "about"),
    ("in regards to", "about"),
    ("in regard to", "about"),
    ("for the purpose of", "to"),
    ("in spite of the fact that", "although"),
    ("on the grounds that", "because"),
    ("in the event that", "if"),
    ("a wide variety of", "many"),
    ("a wide range of", "many"),
    ("the fact that", "that"),
    ("with respect to", "about"),
    ("prior to", "before"),
    ("subsequent to", "after"),
    ("in the process of", "while"),
    ("has the ability to", "can"),
    ("have the ability to", "can"),
    ("is able to", "can"),
    ("are able to", "can"),
    ("in order for", "for"),
    ("I'll walk you through", "walk through"),
    ("I will walk you through", "walk through"),
    ("let me walk you through", "walk through"),
    ("I'll show you how to", "to"),
    ("let me show you how to", "to"),
)
# fixed values: word and replacement
WORDS = (
    ("utilize", "use"),
    ("utilizes", "uses"),
    ("utilized", "used"),
    ("utilizing", "using"),
    ("utilization", "use"),
    ("facilitate", "help"),
    ("facilitates", "helps"),
    ("facilitated", "helped"),
    ("facilitating", "helping"),
    ("leverage", "use"),
    ("leverages", "uses"),
    ("leveraged", "used"),
    ("leveraging", "using"),
    ("commence", "start"),
    ("commences", "starts"),
    ("commenced", "started"),
    ("commencing", "starting"),
    ("terminate", "end"),
    ("terminates", "ends"),
    ("terminated", "ended"),
    ("terminating", "ending"),
    ("endeavor", "try"),
    ("endeavors", "tries"),
    ("endeavored", "tried"),
    ("endeavoring", "trying"),
    ("delve", "dig"),
    ("delves", "digs"),
    ("delved", "dug"),
    ("delving", "digging"),
    ("furthermore", "also"),
    ("moreover", "also"),
    ("nevertheless", "still"),
    ("nonetheless", "still"),
    ("subsequently", "then"),
    ("approximately", "about"),
    ("numerous", "many"),
    ("aforementioned", "this"),
    ("plethora", "lots"),
    ("myriad", "many"),
)
# fixed values: adjectives that are dropped
FLUFF = (
    "robust",
    "comprehensive",
    "seamless",
    "seamlessly",
    "meticulous",
    "meticulously",
    "groundbreaking",
    "cutting-edge",
    "state-of-the-art",
    "best-in-class",
    "world-class",
    "next-generation",
    "next-gen",
    "game-changing",
    "game-changer",
    "synergistic",
    "synergy",
    "synergies",
    "holistic",
    "paradigm-shifting",
    "paradigm shift",
    "revolutionary",
    "transformative",
)
# fixed values: fillers that are dropped
FILLERS = (
    "basically",
    "just",
    "really",
    "very",
    "actually",
    "simply",
    "clearly",
)
# fixed values: long and short form; "I am" stands alone in the transform
CONTRACTIONS = (
    ("it is", "it's"),
    ("It is", "It's"),
    ("do not", "don't"),
    ("Do not", "Don't"),
    ("does not", "doesn't"),
    ("Does not", "Doesn't"),
    ("did not", "didn't"),
    ("Did not", "Didn't"),
    ("is not", "isn't"),
    ("Is not", "Isn't"),
    ("was not", "wasn't"),
    ("Was not", "Wasn't"),
    ("were not", "weren't"),
    ("Were not", "Weren't"),
    ("has not", "hasn't"),
    ("Has not", "Hasn't"),
    ("have not", "haven't"),
    ("Have not", "Haven't"),
    ("had not", "hadn't"),
    ("Had not", "Hadn't"),
    ("cannot", "can't"),
    ("Cannot", "Can't"),
    ("will not", "won't"),
    ("Will not", "Won't"),
    ("would not", "wouldn't"),
    ("Would not", "Wouldn't"),
    ("could not", "couldn't"),
    ("Could not", "Couldn't"),
    ("should not", "shouldn't"),
    ("Should not", "Shouldn't"),
    ("we are", "we're"),
    ("We are", "We're"),
    ("they are", "they're"),
    ("They are", "They're"),
    ("you are", "you're"),
    ("You are", "You're"),
    ("that is", "that's"),
    ("That is", "That's"),
    ("there is", "there's"),
    ("There is", "There's"),
)
# fixed values: phrase and replacement of the description shrinker
SHRINK_PHRASES = (
    ("in order to", "to"),
    ("make use of", "use"),
    ("a number of", "several"),
    ("at this point in time", "now"),
    ("due to the fact that", "because"),
    ("with regard to", "about"),
    ("in the event that", "if"),
    ("for the purpose of", "for"),
    ("in spite of the fact that", "despite"),
    ("each and every", "every"),
    ("the ability to", "ability to"),
    ("it is important to note that", ""),
    ("please note that", ""),
    ("it should be noted that", ""),
    ("you can use this to", "use to"),
)
# fixed values: single filler words of the description shrinker
SHRINK_WORDS = (
    "the",
    "a",
    "an",
    "just",
    "really",
    "basically",
    "actually",
    "simply",
    "essentially",
    "very",
    "quite",
    "somewhat",
    "rather",
    "fairly",
    "please",
    "kindly",
    "note",
    "noted",
)
