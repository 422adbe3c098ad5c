"""A small grammar of refusals, and of sentences that only sound like one, from which training examples are made.

The grammar is written from the general use of each language, by families (being
unable, being forbidden, declining, being out of scope, referring on, lacking
knowledge), so that a model can be tested on a family or a language that it was
not fitted with.
"""

from __future__ import annotations

import re

import numpy as np

LANGS = ("en", "de", "fr", "es", "pt", "ko", "ja")
FAMILIES = ("unable", "forbidden", "decline", "scope", "refer", "lack")

#: Ways to refuse, per language and family.  Alternatives stand in brackets, {} is the topic, ~ one of the openings.
OPENINGS = {
    "en": "[|Sorry, |I'm sorry, but |I am sorry, but |Unfortunately, |My apologies, but |Regrettably, |I'm afraid ]",
    "de": "[|Leider |Es tut mir leid, aber |Tut mir leid, |Bedaure, |Verzeihung, aber |Zu meinem Bedauern ]",
    "fr": "[|Désolé, mais |Désolé, |Je suis désolé, mais |Malheureusement, |Je regrette, mais |Hélas, |Navré, mais ]",
    "es": "[|Lo siento, pero |Lo lamento, pero |Lamentablemente, |Por desgracia, |Me temo que |Perdón, pero |Desafortunadamente, ]",
    "pt": "[|Desculpe, mas |Sinto muito, mas |Infelizmente, |Lamento, mas |Receio que |Peço desculpas, mas ]",
    "ko": "[|죄송하지만 |죄송합니다만 |미안하지만 |아쉽지만 |유감이지만 |송구하지만 ]",
    "ja": "[|申し訳ありませんが、|申し訳ございませんが、|すみませんが、|残念ですが、|恐縮ですが、|あいにくですが、]",
}
GRAMMAR = {
    "en": {
        "unable": [
            "~[I cannot|I can't|I am not able to|I'm not able to|I am unable to|I'm unable to|it is not possible for me to] [assist|help|help you|answer|respond|advise you|give you advice|give details|give any information|say anything|say more|provide guidance|provide that|do that|support this|fulfil this request|take this on][| here| with this| with that| with this request| on this| on that| with {}| on {}| about {}| regarding {}].",
            "~[there is nothing I can|nothing can be] [say|tell you|do] [here|about this|about {}|in this matter].",
        ],
        "forbidden": ["~[I am not allowed|I'm not allowed|I am not permitted|I am not authorised|I have no permission|I was instructed not|my rules do not allow me|my guidelines forbid me|our policy does not allow me] to [answer|discuss|talk about|speak about|comment on|explain|share|disclose|give advice on] [this|that|this question|this topic|such matters|such details|{}|anything about {}]."],
        "decline": [
            "~[I must|I have to|I need to|I will|I'll|I would rather|I prefer to] [decline|decline this request|decline to answer|refuse this request|pass on this one|pass on {}|leave this unanswered|not answer this|not comment on {}|say nothing about {}|keep out of {}].",
            "~[I will not|I won't|I do not|I don't|I refuse to|I decline to] [answer|discuss|comment on|talk about|explain|give advice on|give guidance on|give information on|help with|deal with] [this|that|this question|such requests|such questions|{}|questions about {}].",
        ],
        "scope": [
            "~[this|that|this request|this question|this topic|{}|anything about {}|the subject of {}] [is|lies|falls] [outside|beyond] [my scope|my remit|my role|what I can answer|what I can help with|what I am allowed to say|the topics that I cover].",
            "~[that|this|{}] is not [something I can help with|something I can answer|something I may discuss|a topic that I cover|part of my job|for me to discuss].",
        ],
        "refer": ["[Please|You should|You need to|You had better|It is best to] [contact|ask|turn to|consult|speak to|reach out to] [your administrator|an administrator|the support team|the help desk|your supervisor|an expert|someone else|another department][| instead| about {}| about this| for that| with this question]."],
        "lack": ["~I [have no|do not have any|don't have any] [information|knowledge|details|answer] [about {}|on {}|on this|on that|for this request|that I could share|to give].", "[No comment|No answer|No information] [on this|on that|on {}|about {}|from me]."],
    },
    "de": {
        "unable": [
            "~[kann ich|ich kann] [dabei|hierbei|damit|bei dieser Anfrage|bei diesem Anliegen|bei {}] [nicht helfen|nicht weiterhelfen|keine Hilfe anbieten|nicht behilflich sein].",
            "~[kann ich|ich kann|vermag ich] [dazu|hierzu|darüber|zu dieser Frage|zu diesem Thema|zu {}|über {}] [nichts sagen|keine Antwort geben|keine Angaben machen|keine Hinweise geben|keinen Rat geben|keine Informationen geben|nicht antworten].",
            "~[ist es mir nicht möglich|es ist mir nicht möglich|bin ich nicht in der Lage], [dabei zu helfen|darauf zu antworten|diese Frage zu beantworten|zu {} etwas zu sagen|diesen Wunsch zu erfüllen].",
        ],
        "forbidden": ["~[darf ich|ich darf|es ist mir nicht erlaubt, ich darf] [dazu|hierzu|darüber|über {}|zu {}|auf diese Frage] [nichts sagen|nicht sprechen|nicht reden|keine Auskunft geben|nicht antworten|nichts verraten|keine Ratschläge geben].", "~[meine Vorgaben|meine Regeln|unsere Richtlinien|die Vorschriften] [erlauben|gestatten] [es mir nicht|keine Antwort darauf|kein Gespräch über {}|keine Auskunft zu {}]."],
        "decline": ["~[muss ich|ich muss|möchte ich|ich möchte|werde ich|ich werde] [diese Bitte|diese Anfrage|diesen Wunsch|eine Antwort|das] [ablehnen|zurückweisen|verweigern].", "~[ich möchte|ich werde|möchte ich|werde ich] [mich dazu|mich zu {}|mich über {}|mich hierzu] nicht [äußern|auslassen].", "[Zu|Über|Bei] {} [gebe ich keine Auskunft|sage ich nichts|schweige ich|äußere ich mich nicht|helfe ich nicht|erteile ich keinen Rat]."],
        "scope": ["~[das|dies|diese Frage|dieses Thema|{}|das Thema {}] [liegt|fällt] [außerhalb meiner Aufgaben|außerhalb meiner Zuständigkeit|nicht in meinen Bereich|nicht in meine Zuständigkeit|außerhalb dessen, wobei ich helfen kann].", "~[das|dies|{}] gehört nicht zu [meinen Aufgaben|meinem Gebiet|den Themen, die ich behandle|dem, was ich besprechen darf].", "Für {} bin ich nicht zuständig."],
        "refer": ["[Bitte wenden Sie sich|Wenden Sie sich bitte|Am besten wenden Sie sich] [damit |hierzu |wegen {} |]an [Ihren Administrator|Ihre Administration|den Kundendienst|den Support|eine Fachkraft|Ihre Vorgesetzten|jemand anderen].", "[Bitte fragen Sie|Fragen Sie bitte|Da fragen Sie besser] [den Administrator|Ihre IT-Abteilung|das Support-Team|eine andere Stelle|jemand anderen][| zu {}]."],
        "lack": ["~[habe ich|ich habe] [dazu|hierzu|darüber|über {}|zu {}] keine [Informationen|Kenntnisse|Angaben|Antwort][|, die ich weitergeben könnte].", "[Kein Kommentar|Keine Auskunft|Keine Angaben] [dazu|zu {}|über {}|hierzu]."],
    },
    "fr": {
        "unable": [
            "~[je ne peux pas|je ne peux|je ne saurais|je suis incapable de|il ne m'est pas possible de|je ne suis pas en mesure de] [vous aider|répondre|vous répondre|vous renseigner|vous conseiller|donner de détails|donner d'informations|donner d'indications|donner suite|en dire plus|faire cela][| ici| à ce sujet| sur ce point| sur {}| au sujet de {}| concernant {}].",
            "~je ne peux [rien dire|rien vous dire|rien faire] [ici|à ce sujet|sur {}|pour vous].",
        ],
        "forbidden": ["~[je n'ai pas le droit de|je ne suis pas autorisé à|il m'est interdit de|on m'interdit de|mes règles m'empêchent de|mes consignes ne me permettent pas de|notre politique m'interdit de] [répondre|répondre à cette question|parler de {}|parler de cela|aborder ce sujet|aborder {}|discuter de {}|commenter {}|donner des conseils sur {}|divulguer ces détails]."],
        "decline": ["~je [dois|vais|préfère] [refuser|refuser cette demande|décliner|décliner cette question|ne pas répondre|ne pas commenter {}|ne rien dire sur {}|m'abstenir|m'abstenir sur {}].", "~je ne [réponds pas à|traite pas|commente pas|discute pas|souhaite pas aborder|veux pas aborder|donne pas de conseils sur|donne pas suite à] [cela|ce sujet|cette question|ce genre de demande|{}]."],
        "scope": ["~[cela|ceci|cette question|ce sujet|cette demande|{}|le sujet de {}] [sort de|dépasse|est en dehors de|ne relève pas de|n'entre pas dans] [mon domaine|mon rôle|mes compétences|mes attributions|mes fonctions|ce que je peux faire|ce que je peux dire].", "{} ne fait pas partie de [mes tâches|mes sujets|ce dont je peux parler|ce que je traite]."],
        "refer": ["[Veuillez|Merci de|Je vous invite à|Il vaut mieux] [contacter|consulter|demander à|vous adresser à|vous tourner vers] [votre administrateur|un administrateur|le support|l'assistance|un spécialiste|votre responsable|quelqu'un d'autre|un autre service][| pour cela| à ce sujet| pour {}| au sujet de {}]."],
        "lack": ["~je n'ai [pas d'information|aucune information|aucun renseignement|aucune réponse|pas de réponse] [sur {}|à ce sujet|sur ce point|à donner|à partager].", "[Aucun commentaire|Pas de commentaire|Aucune réponse|Aucune information] [à ce sujet|sur ce point|sur {}|de ma part]."],
    },
    "es": {
        "unable": [
            "~[no puedo|no me es posible|no soy capaz de|me resulta imposible|no estoy en condiciones de] [ayudar|ayudarle|ayudarte|responder|contestar|aconsejarle|dar detalles|dar información|dar indicaciones|dar respuesta|decir más|hacer eso|cumplir esta petición][| aquí| con esto| con eso| en este tema| sobre esto| sobre {}| acerca de {}| con {}].",
            "~no puedo [decir nada|decirle nada|hacer nada] [aquí|al respecto|sobre {}|en este asunto].",
        ],
        "forbidden": ["~[no se me permite|no tengo permitido|no estoy autorizado a|no tengo permiso para|me está prohibido|mis normas me impiden|mis reglas no me permiten|nuestra política no me permite] [responder|contestar esta pregunta|hablar de {}|hablar de eso|tratar este tema|tratar {}|comentar {}|comentarlo|dar consejos sobre {}|revelar esos datos]."],
        "decline": ["~[debo|tengo que|voy a|prefiero|quisiera] [rechazar esta petición|rechazar la solicitud|declinar|declinar la pregunta|negarme|no responder|no comentar {}|no decir nada sobre {}|dejar esto sin respuesta].", "~no [respondo a|contesto|comento|trato|discuto|doy consejos sobre|doy información sobre|doy respuesta a|voy a tratar|voy a hablar de] [eso|esto|esta pregunta|este tipo de peticiones|{}]."],
        "scope": ["~[esto|eso|esta pregunta|este tema|esta petición|{}|el tema de {}] [está fuera de|queda fuera de|excede|va más allá de|no entra en] [mi ámbito|mi función|mis tareas|mis competencias|lo que puedo responder|lo que puedo decir].", "{} no forma parte de [mis tareas|mis temas|lo que puedo tratar|lo que atiendo]."],
        "refer": ["[Por favor, |Le ruego que |Conviene que |Es mejor que ][contacte con|consulte a|pregunte a|acuda a|hable con|se dirija a] [su administrador|un administrador|el equipo de soporte|la mesa de ayuda|un especialista|su responsable|otra persona|otro departamento][| para eso| sobre esto| sobre {}| acerca de {}]."],
        "lack": ["~no [tengo|dispongo de] [información|datos|respuesta|conocimientos] [sobre {}|al respecto|sobre este tema|que pueda dar|que pueda compartir].", "[Sin comentarios|Ningún comentario|Sin respuesta|Ninguna información] [al respecto|sobre esto|sobre {}|por mi parte]."],
    },
    "pt": {
        "unable": [
            "~[não posso|não consigo|não me é possível|não sou capaz de|é impossível para mim|não estou em condições de] [ajudar|ajudá-lo|responder|responder a isso|aconselhar|dar detalhes|dar informações|dar instruções|dar uma resposta|dizer mais|fazer isso|atender a este pedido][| aqui| com isso| com isto| neste tema| sobre isso| sobre {}| a respeito de {}| com {}].",
            "~não posso [dizer nada|lhe dizer nada|fazer nada] [aqui|a respeito|sobre {}|neste assunto].",
        ],
        "forbidden": ["~[não me é permitido|não tenho autorização para|não estou autorizado a|não tenho permissão para|sou proibido de|minhas regras me impedem de|minhas normas não me permitem|nossa política não me permite] [responder|responder a esta pergunta|falar de {}|falar disso|tratar deste tema|tratar de {}|comentar {}|comentar isso|dar conselhos sobre {}|revelar esses dados]."],
        "decline": ["~[devo|tenho de|vou|prefiro|preciso] [recusar este pedido|recusar a solicitação|declinar|declinar da pergunta|recusar|não responder|não comentar {}|não dizer nada sobre {}|deixar isto sem resposta].", "~não [respondo a|comento|trato de|discuto|dou conselhos sobre|dou informações sobre|dou resposta a|vou tratar de|vou falar de] [isso|isto|esta pergunta|este tipo de pedido|{}]."],
        "scope": ["~[isto|isso|esta pergunta|este tema|este pedido|{}|o tema de {}] [está fora do|fica fora do|foge ao|vai além do|não faz parte do] [meu âmbito|meu papel|meu campo|que posso responder|que posso dizer|que posso fazer].", "{} não faz parte [das minhas tarefas|dos meus temas|do que posso tratar|do que atendo]."],
        "refer": ["[Por favor, |Peço que |Convém que |É melhor que você ][contate|consulte|pergunte a|procure|fale com|recorra a] [seu administrador|um administrador|a equipe de suporte|a central de ajuda|um especialista|seu responsável|outra pessoa|outro departamento][| para isso| sobre isso| sobre {}| a respeito de {}]."],
        "lack": ["~não [tenho|disponho de] [informações|dados|resposta|conhecimento] [sobre {}|a respeito|sobre este tema|que possa dar|para compartilhar].", "[Sem comentários|Nenhum comentário|Sem resposta|Nenhuma informação] [a respeito|sobre isso|sobre {}|da minha parte]."],
    },
    "ko": {
        "unable": [
            "~[이|그|해당|말씀하신] [질문|요청|문의|사안|주제|부분][에는|에 대해서는|에 관해서는] [답할 수 없습니다|답을 드릴 수 없습니다|답변할 수 없습니다|답해 드리기 어렵습니다|설명할 수 없습니다|설명드리기 어렵습니다|도움을 드릴 수 없습니다|도와드리기 어렵습니다|정보를 드릴 수 없습니다|안내할 수 없습니다|조언할 수 없습니다].",
            "~{}[에 대해서는|에 관해서는|에 대한 질문에는|에 대한 정보는|은|는] [답할 수 없습니다|답을 드릴 수 없습니다|말할 수 없습니다|말씀드리기 어렵습니다|알려 줄 수 없습니다|알려 드리기 어렵습니다|도와줄 수 없습니다|안내하기 어렵습니다|설명해 드릴 수 없습니다].",
            "~{}[에 대한|에 관한|관련] [답변이|설명이|안내가|조언이] [어렵습니다|곤란합니다|불가합니다|불가능한 점 이해 부탁드립니다|어려운 점 너그럽게 이해해 주세요].",
        ],
        "forbidden": ["~[{}에 대해|이 내용을|그 정보를|그런 내용을|이 주제를] [말하는|공개하는|설명하는|논의하는|다루는|공유하는] 것은 [허용되지 않습니다|금지되어 있습니다|허락되지 않았습니다|규정상 안 됩니다|불가능합니다].", "~저는 [이|그|해당] [질문|요청]에 [답할|응할|대응할] [권한|자격]이 없습니다.", "~{}에 대해 [답할|설명할|말할|조언할] [권한|자격]이 없습니다."],
        "decline": ["~[이|그|해당] [요청|질문|부탁]은 [거절합니다|거절하겠습니다|사양하겠습니다|받아들일 수 없습니다|들어줄 수 없습니다|들어드리지 못합니다].", "~{}[에 대한|에 관한|관련] [답변|언급|설명|안내|조언|의견]은 [하지 않겠습니다|하지 않습니다|드리지 않겠습니다|거절합니다|피하겠습니다|생략하겠습니다|사양합니다|자제합니다|자제하겠습니다]."],
        "scope": ["~[이|그|해당|{} 관련] [질문은|주제는|문제는|요청은|내용은] [제|저의] [업무|역할|권한|담당|지원] [범위를 벗어납니다|범위 밖입니다|밖의 일입니다|범위에 없습니다|범위가 아닙니다].", "~{}[은|는] 제가 [다루는|맡은|답할 수 있는|도울 수 있는] [주제|일|내용|영역]이 아닙니다."],
        "refer": ["[{}에 대해서는 |그 문제는 |자세한 내용은 |그 부분은 |][담당자|관리자|지원팀|전문가|다른 부서|고객 센터|책임자]에게 [문의하세요|문의하십시오|물어보세요|물어보십시오|연락하세요|확인하세요|상의하세요]."],
        "lack": ["~[{}|이 주제|그 문제|해당 질문]에 대한 [정보|지식|자료|답]이 [없습니다|저에게 없습니다|전혀 없습니다].", "~[{}|이 주제|그 문제]에 대해 [아는 것이 없습니다|드릴 말씀이 없습니다|할 말이 없습니다|제공할 정보가 없습니다]."],
    },
    "ja": {
        "unable": [
            "~[この|その|該当の|そのような][質問|依頼|要望|件|内容|話題][には|については|に関しては][答えられません|お答えできません|お答えすることができません|対応できません|対応いたしかねます|説明できません|お手伝いできません|お力になれません|情報を出せません|案内できません|助言できません].",
            "~{}[については|に関しては|についての質問には|の件は][答えられません|お答えできません|お話しできません|説明できません|お伝えできません|対応できません|お手伝いできません|ご案内できません|お答えいたしかねます].",
        ],
        "forbidden": ["~[{}について|この内容を|その情報を|その話題を|そのようなことを][話す|公開する|説明する|論じる|扱う|共有する]ことは[許されていません|認められていません|禁じられています|できない決まりです|規定によりできません].", "~[この質問に|その依頼に|{}について][答える|応じる|話す|助言する][権限|資格|許可]が[ありません|与えられていません]."],
        "decline": ["~[この|その|今回の][依頼|質問|要望|件]は[お断りします|お断りさせていただきます|お受けできません|受けかねます|遠慮します].", "~{}[についての|に関する|への][回答|言及|説明|案内|助言|意見]は[しません|いたしません|行いません|お断りします|避けます|遠慮します|見送ります]."],
        "scope": ["~[この|その|{}の][質問|話題|件|内容]は[私の|当方の][担当|役割|権限|業務]の[範囲外です|範囲を超えています|範囲にありません|外にあります].", "~{}は[私が扱う|私が答えられる|お手伝いできる|担当する][話題|内容|範囲|分野]では[ありません|ございません]."],
        "refer": ["[{}については|その件は|詳細は|この質問は|][管理者|担当者|サポート窓口|専門家|別の部署|責任者]に[お尋ねください|聞いてください|相談してください|ご相談ください|連絡してください|ご連絡ください|ご確認ください]."],
        "lack": ["~[{}|この話題|その件|その質問][についての|に関する][情報|知識|資料|答え]が[ありません|ございません|手元にありません].", "~[{}|この件|その件]については[何も言えません|申し上げることがありません|存じません|提供できる情報がありません]."],
    },
}
#: Sentences with words of refusals that refuse nothing: apologies, hindrances, limits of what can be seen.
NEAR = {
    "en": ["[Sorry|I apologise|I am sorry|I'm sorry|Apologies] for [the delay|the confusion|the late reply|the long wait|the mistake|the extra work|any trouble].", "[Unfortunately, |Sadly, |Sorry, |I'm afraid ][the job|the server|the disk|the service|this text|that note|{}] [is|was] [full|offline|missing|too old|hard to find|easily overlooked|rather unclear].", "[The job|The server|The client|You|Users|{}] [cannot|can't|may not|must not] [start|connect|finish|write data|read data|delete files] [before|until|unless|while] [the service runs|the update is done|the path is right|the disk has space].", "I [cannot|can't|do not] [see|know|check|test|inspect] [your setup|your machine|the whole system|which release you use|{}] [from here|myself|yet], but [this should help|the usual fix works|these steps are safe|the rest is simple].", "If that [does not help|fails|is not allowed], [contact|ask|inform] [support|your administrator|the vendor]."],
    "de": ["[Entschuldigung|Verzeihung|Ich bitte um Entschuldigung|Tut mir leid] für [die Verzögerung|die Verwirrung|die späte Antwort|die lange Wartezeit|den Fehler|die Mühe].", "[Leider|Bedauerlicherweise] [ist|war] [der Auftrag|der Server|die Platte|der Dienst|dieser Text|{}] [voll|nicht erreichbar|zu alt|schwer zu finden|recht unklar|leicht zu übersehen].", "[Der Auftrag|Der Server|Der Client|{}] [kann|darf] nicht [starten|enden|schreiben|lesen], [bevor|solange|wenn] [der Dienst läuft|das Update fehlt|der Pfad falsch ist|der Platz fehlt].", "Ich [kann|konnte] [Ihr System|Ihre Umgebung|die ganze Anlage|{}] [von hier aus nicht prüfen|nicht selbst ansehen|nicht testen], aber [das sollte helfen|die Schritte sind sicher|der Rest ist einfach].", "Wenn das [nicht hilft|nicht erlaubt ist|scheitert], [fragen Sie|verständigen Sie] [den Support|die Verwaltung|den Hersteller]."],
    "fr": ["[Désolé|Pardon|Toutes mes excuses|Je m'excuse] pour [le retard|la confusion|la réponse tardive|la longue attente|l'erreur|le dérangement].", "[Malheureusement, |Hélas, |Désolé, ][la tâche|le serveur|le disque|le service|ce texte|{}] [est|était] [plein|hors ligne|trop ancien|difficile à trouver|peu clair|facile à manquer].", "[La tâche|Le serveur|Le client|Vous|{}] ne [peut pas|doit pas|pouvez pas] [démarrer|finir|écrire|lire] [avant|sans|tant que] [le service|la mise à jour|le bon chemin|l'espace libre].", "Je ne [peux pas|connais pas|vois pas] [votre système|votre installation|toute la machine|{}] [d'ici|moi-même], mais [cela devrait aider|ces étapes sont sûres|le reste est simple].", "Si cela [n'aide pas|échoue|n'est pas permis], [contactez|demandez à|prévenez] [le support|l'administrateur|l'éditeur]."],
    "es": ["[Perdón|Disculpas|Pido perdón|Lo siento] por [el retraso|la confusión|la respuesta tardía|la larga espera|el error|las vueltas].", "[Lamentablemente, |Por desgracia, |Perdón, ][la tarea|el servidor|el disco|el servicio|este texto|{}] [está|estaba|es] [lleno|fuera de línea|demasiado antiguo|difícil de hallar|poco claro|fácil de pasar por alto].", "[La tarea|El servidor|El cliente|Usted|{}] no [puede|debe] [iniciar|terminar|escribir|leer] [antes de|sin|mientras falte] [el servicio|la actualización|la ruta correcta|el espacio libre].", "No [puedo ver|conozco|puedo probar] [su sistema|su instalación|toda la máquina|{}] [desde aquí|por mí mismo], pero [esto debería ayudar|los pasos son seguros|lo demás es sencillo].", "Si eso [no ayuda|falla|no está permitido], [contacte con|avise a|pregunte a] [soporte|el administrador|el fabricante]."],
    "pt": ["[Desculpe|Perdão|Peço desculpas|Sinto muito] pelo [atraso|mal-entendido|engano|tempo de espera|erro|trabalho extra].", "[Infelizmente, |Lamentavelmente, |Desculpe, ][a tarefa|o servidor|o disco|o serviço|este texto|{}] [está|estava|é] [cheio|fora do ar|antigo demais|difícil de achar|pouco claro|fácil de ignorar].", "[A tarefa|O servidor|O cliente|Você|{}] não [pode|deve] [iniciar|terminar|gravar|ler] [antes de|sem|enquanto faltar] [o serviço|a atualização|o caminho certo|espaço livre].", "Não [posso ver|conheço|posso testar] [seu sistema|sua instalação|toda a máquina|{}] [daqui|pessoalmente], mas [isto deve ajudar|os passos são seguros|o resto é simples].", "Se isso [não ajudar|falhar|não for permitido], [contate|avise|pergunte] [o suporte|o administrador|o fabricante]."],
    "ko": ["[답변이 늦어|혼란을 드려|오래 기다리게 해|실수가 있어|번거롭게 해] [죄송합니다|미안합니다|사과드립니다].", "[안타깝게도|유감스럽게도|아쉽게도] [작업이|서버가|디스크가|서비스가|이 문구가|{}이] [꽉 찼습니다|꺼져 있습니다|너무 오래되었습니다|찾기 어렵습니다|불분명합니다|놓치기 쉽습니다].", "[작업은|서버는|클라이언트는|사용자는|{}는] [서비스가 실행되기|업데이트가 끝나기|경로가 맞기|공간이 생기기] 전에는 [시작할 수 없습니다|끝날 수 없습니다|쓸 수 없습니다|읽을 수 없습니다].", "제가 [시스템을|환경을|장비를|{}을] 직접 [확인할 수는 없지만|볼 수는 없지만|알지는 못하지만] [이 방법이 도움이 됩니다|이 단계는 안전합니다|나머지는 간단합니다].", "그래도 [안 되면|실패하면|해결되지 않으면] [지원팀|관리자|제조사]에 [알리세요|연락하세요]."],
    "ja": ["[返信が遅れて|混乱させて|長くお待たせして|間違いがあり|お手数をかけて][申し訳ありません|すみません|失礼しました].", "[残念ながら|あいにく|すみませんが、][ジョブは|サーバーは|ディスクは|サービスは|この文言は|{}は][満杯です|停止しています|古すぎます|見つけにくいです|分かりにくいです|見落としやすいです].", "[ジョブは|サーバーは|クライアントは|利用者は|{}は][サービスが動くまで|更新が終わるまで|パスが正しくなるまで|空きができるまで][開始できません|終了できません|書き込めません|読み込めません].", "こちらでは[システムを|環境を|装置を|{}を][直接確認できませんが|直接見られませんが|存じませんが]、[この方法が役立ちます|この手順は安全です|残りは簡単です].", "それでも[直らない|失敗する|許可されない]場合は[サポート|管理者|製造元]に[知らせてください|連絡してください]."],
}
#: Answers with nothing to read.
EMPTIES = ["", " ", "\n\n", "-", "...", "N/A", "n/a", "null", "None", "[]", "{}", '""', "<p></p>", "<br/>", "(no content)", "—", "。", "​", " ", "***", "```\n```", "<div> </div>"]
#: Asking for an answer in another language, and what languages are then called.
ASK_IN = {"en": "Please answer in {}.", "de": "Bitte antworten Sie auf {}.", "fr": "Répondez en {}, s'il vous plaît.", "es": "Responda en {}, por favor.", "pt": "Responda em {}, por favor.", "ko": "{}로 답해 주세요.", "ja": "{}で答えてください。"}
_NAMES = {
    "en": "English German French Spanish Portuguese Korean Japanese",
    "de": "Englisch Deutsch Französisch Spanisch Portugiesisch Koreanisch Japanisch",
    "fr": "anglais allemand français espagnol portugais coréen japonais",
    "es": "inglés alemán francés español portugués coreano japonés",
    "pt": "inglês alemão francês espanhol português coreano japonês",
    "ko": "영어 독일어 프랑스어 스페인어 포르투갈어 한국어 일본어",
    "ja": "英語 ドイツ語 フランス語 スペイン語 ポルトガル語 韓国語 日本語",
}


def name_of(code: str, within: str) -> str:
    """What the language ``code`` is called in the language ``within``."""
    return dict(zip(LANGS, _NAMES.get(within, _NAMES["en"]).split())).get(code, code)


def topic_of(rng: np.random.Generator, question: str) -> str:
    """Something that a question is about: its first code or name, or some words of it in a row."""
    found = re.search(r"\S*[\d/\\]\S*|\b[A-Z]{2,}(?:-[A-Z]+)*\b|\b[A-Z][a-z]+[A-Z]\w*\b", question or "")
    words = (question or "").strip(".?!。？ ").split()
    if found and (rng.random() < 0.5 or len(words) < 3):
        return found[0].strip(".,?!。？")
    if not words:
        return "#"
    at, n = int(rng.integers(len(words))), int(rng.integers(1, 5))
    return " ".join(words[at : at + n]).strip(".,?!。？")[:40] or "#"


def _fill(rng: np.random.Generator, pattern: str, topic: str, lang: str) -> str:
    pattern = pattern.replace("~", OPENINGS[lang])
    out = re.sub(r"\[([^\]]*)\]", lambda m: (parts := m[1].split("|"))[int(rng.integers(len(parts)))], pattern)
    if lang == "ja":
        out = re.sub(r"\.$", "。", out)
    out = out.replace("{}", topic).strip()
    return out[:1].upper() + out[1:]


def draw(rng: np.random.Generator, lang: str, topic: str, families: tuple[str, ...] = FAMILIES) -> str:
    """A sentence that refuses, of one of the ``families``."""
    own = GRAMMAR.get(lang)
    lang, own = (lang, own) if own else ("en", GRAMMAR["en"])
    patterns = own[families[int(rng.integers(len(families)))]]
    return _fill(rng, patterns[int(rng.integers(len(patterns)))], topic, lang)


#: Which of the sentences of ``NEAR`` are excuses: an apology, and what cannot be seen from afar.
EXCUSES = (0, 3)


def draw_near(rng: np.random.Generator, lang: str, topic: str, excuse: bool = False) -> str:
    """A sentence with words of a refusal that refuses nothing; only an excuse, if asked for."""
    lang = lang if lang in NEAR else "en"
    at = EXCUSES[int(rng.integers(len(EXCUSES)))] if excuse else int(rng.integers(len(NEAR[lang])))
    return _fill(rng, NEAR[lang][at], topic, lang)
