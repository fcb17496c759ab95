"""Complaint-theme rules. Texts are reduced to lower-case letters and single spaces before they are matched."""

from __future__ import annotations

# The alternatives of each theme, as whole words. They must equal the published rules.
RULES_V2 = {
    "non_delivery": r"n[aã]o recebi|n[aã]o chegou|n[aã]o foi entregue|ainda n[aã]o|aguardando|nunca chegou",
    "delivery_delay": r"atras\w*|demor\w*|fora do prazo|ap[oó]s o prazo|depois do prazo|prazo (?:j[aá] )?(?:pass\w*|venc\w*|estour\w*)|entrega tard\w*",
    "wrong_or_missing_item": r"errad\w*|falt\w*|incomplet\w*|veio outro|produto diferente|item diferente",
    "damaged_or_defective": r"defeit\w*|quebrad\w*|danific\w*|avariad\w*|n[aã]o funciona\w*",
    "quality_or_expectation": r"qualidade|ruim|p[eé]ssim\w*|propaganda|foto|tamanho|material|acabamento|diferente do anunciado",
    "service_or_refund": r"atendimento|contato|resposta|retorno|troca|devolu[cç][aã]o|reembolso|estorno|cancel\w*|dinheiro",
}
RULES_V3 = {
    "non_delivery": (
        r"(?:n[aã]o|n) (?:recebi|recebeu|recebemos) (?:o |a |os |as |meu |minha )?(?:produto|pedido|mercadoria|encomenda|compra)|"
        r"(?:produto|pedido|mercadoria|encomenda|compra) n[aã]o (?:chegou|foi entregue)|(?:n[aã]o|n) chegou|nunca chegou|"
        r"ainda n[aã]o (?:recebi|chegou|foi entregue)|(?:n[aã]o|n) foi entregue"
    ),
    "delivery_delay": (
        r"(?:entrega|produto|pedido|mercadoria|encomenda|correios).{0,50}(?:atras\w*|demor\w*|fora do prazo|depois do prazo)|"
        r"(?:atras\w*|demor\w*|fora do prazo|depois do prazo).{0,50}(?:entrega|produto|pedido|mercadoria|encomenda|correios)|"
        r"prazo (?:j[aá] )?(?:pass\w*|venc\w*|estour\w*)|entrega tard\w*"
    ),
    "wrong_or_missing_item": (
        r"(?:recebi|veio|enviaram).{0,50}(?:outro|diferente|marca (?:errada|diferente))|(?:produto|item|mercadoria|pedido).{0,30}(?:errad\w*|diferente)|"
        r"(?:falt\w*).{0,30}(?:pe[cç]a|item|produto|unidade|componente|acess[oó]rio)|"
        r"(?:pe[cç]a|item|produto|unidade|componente|acess[oó]rio).{0,30}(?:falt\w*)|incomplet\w*"
    ),
    "damaged_or_defective": (
        r"defeit\w*|quebrad\w*|danific\w*|avariad\w*|rachad\w*|(?:produto|item|aparelho|rel[oó]gio).{0,30}n[aã]o funciona\w*|"
        r"n[aã]o funciona\w*.{0,30}(?:produto|item|aparelho|rel[oó]gio)|parou de funcionar"
    ),
    "quality_or_expectation": (
        r"(?:qualidade|material|acabamento).{0,35}(?:ruim|p[eé]ssim\w*|baixa|inferior|fr[aá]gil|horr[ií]vel)|"
        r"(?:ruim|p[eé]ssim\w*|baixa|inferior|fr[aá]gil|horr[ií]vel).{0,35}(?:qualidade|material|acabamento)|"
        r"diferente (?:da foto|do anunciado|da descri[cç][aã]o)|n[aã]o (?:foi|era) (?:a marca|como na foto|como anunciado)|falsific\w*"
    ),
    "service_or_refund": (
        r"(?:n[aã]o|sem|nunca).{0,35}(?:contato|resposta|retorno|atendimento|solu[cç][aã]o|reembolso|estorno|dinheiro)|"
        r"(?:contato|resposta|retorno|atendimento).{0,35}(?:n[aã]o|sem|nunca)|aguard\w*.{0,25}(?:retorno|resposta|reembolso|estorno)|"
        r"(?:reembolso|estorno).{0,35}(?:n[aã]o|nunca|aguard\w*|demor\w*)|problema.{0,25}n[aã]o resolvid\w*|sem solu[cç][aã]o|cancel\w*|devolv\w*"
    ),
}
POSITIVE = r"recomendo|[oó]tim\w*|excelente|perfeit\w*|tudo correto|tudo certo|muito bom|parab[eé]ns"
FALLBACK = ("other", "uncertain")
THEMES = (*RULES_V3, *FALLBACK)

#: Rules for the invented words of the synthetic corpus, to run the same operator at scale.
RULES_SYNTHETIC = {
    "delivery_delay": r"worthless|thanin\w*|einung\w*",
    "damaged_or_defective": r"pathetic|ered\w*|enier\w*",
    "quality_or_expectation": r"stupid|onre\w*|ciónas\w*",
}


def whole_words(alternatives: str) -> str:
    """The published rule, a word boundary at either end, spelt the same for every regex engine. Texts are letters and
    single spaces, so a boundary is a space or an end; a word sign is an ASCII one, as the published rules have it on Java
    17: a stem that an accented letter follows before the word ends does not match."""
    return "(?:^| )(?:" + alternatives.replace(r"\w", "[a-z]") + ")(?: |$)"
