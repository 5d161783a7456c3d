"""Text predicates of the rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that the rules compare with.
GENERIC_ALT = (
    "imagem", "image", "figura", "figure", "foto", "photo", "grafico",
    "gráfico", "chart", "picture", "img", "logo", "icone", "ícone", "icon",
    "diagrama", "tabela", "screenshot", "captura de tela", "sem descricao",
    "sem descrição", "descricao", "descrição", "alt", "texto alternativo",
)
VAGUE_LINK = (
    "clique aqui", "clique", "aqui", "leia mais", "saiba mais",
    "veja mais", "link", "mais", "click here", "here", "read more",
    "learn more", "this link", "este link",
)
SANS_SAFE = (
    "arial", "calibri", "verdana", "tahoma", "segoe ui", "open sans",
    "helvetica", "helvetica neue", "roboto", "noto sans", "lato",
    "source sans pro", "atkinson hyperlegible", "opendyslexic",
    "arial narrow", "trebuchet ms", "franklin gothic book",
    "aptos", "aptos display",
)
NEEDS_ACCENT = (
    "nao", "sao", "tambem", "voce", "ate", "apos", "alem", "atraves", "porem",
    "assessoria", "codigo", "pagina", "paginas", "tecnica", "tecnico", "publico",
    "publica", "unico", "unica", "ultimo", "ultima", "proprio", "propria",
    "criterio", "criterios", "referencia", "referencias", "descricao",
    "descricoes", "informacao", "informacoes", "acao", "acoes", "versao",
    "versoes", "opcao", "opcoes", "secao", "secoes", "atencao", "conteudo",
    "audio", "video", "videos", "area", "areas", "ideia", "titulo", "titulos",
    "numero", "numeros", "musica", "grafico", "graficos", "imagens",
    "acessivel", "acessiveis", "possivel", "possiveis", "nivel", "niveis",
    "minimo", "maximo", "obrigatorio", "necessario", "usuario", "usuarios",
    "relatorio", "auditoria", "sera", "esta", "tres", "orgao", "orgaos",
    "servico", "servicos", "excecao", "duvida", "voces", "aqui", "ambito",
    "avaliacao", "aplicacao", "traducao", "legenda",
)
KNOWN_ACRONYMS = (
    "PDF", "HTML", "XML", "CSS", "PNG", "JPG", "GIF", "MP3", "MP4", "SRT",
    "YAML", "JSON", "ZIP", "URL", "API", "CLI", "GPU", "CPU", "USB", "USP",
    "UFF", "ABNT", "NBR", "ISO", "WCAG", "PPTX", "DOCX", "OOXML", "EMU",
    "AAA", "III", "PT", "BR", "EUA", "W3C", "IFLA", "ITU", "CNMP",
)
EMPHASIS_WORDS = (
    "NÃO", "NAO", "SIM", "TODOS", "NUNCA", "SEMPRE", "MAS",
    "OU", "SEM", "COM", "POR", "PARA", "UMA", "DOIS", "TRES",
)
GENERIC_AUTHORS = ("usuario do windows", "usuário do windows", "windows user", "user", "autor")
FILE_SUFFIX = r"(?iu)\.(png|jpe?g|gif|bmp|svg|emf|wmf|tiff?|webp|pdf|mp4|mp3|wav)\s*$"
AUTOMATIC_ALT = (
    r"(?iu)(descri[cç][aã]o gerada automaticamente|generated by ai|conte[uú]do gerado por ia"
    r"|ai[- ]generated|automatically generated)"
)
ALT_PREFIX = (
    r"(?iu)^\s*(uma?\s+)?(imagem|foto(grafia)?|figura|gr[aá]fico|ilustra[cç][aã]o|captura de tela"
    r"|screenshot|picture|image|photo|chart)\s+(de|do|da|dos|das|que|com|showing|of)([^\pL\pN_]|$)"
)
RAW_URL = r"(?i)^\s*(https?://|www\.)"
GENERIC_FILE_NAME = r"(?iu)^(apresenta[cç][aã]o|presentation|slide|deck|documento)\s*\d*$"
DEFAULT_SECTION = r"(?iu)^(se[cç][aã]o|section)\s*(padr[aã]o|default)?\s*\d*$"
TYPED_BULLET = r"^[-*•·]\s+\S"
AUTOMATIC_NAME = (
    r"(?iu)^(rectangle|oval|picture|imagem|text ?box|caixa de texto|retangulo|retângulo|elipse|forma"
    r"|shape|group|grupo|content placeholder|espa[cç]o reservado)\s*\d+$"
)

#: A small letter in a word of two letters or more.
SMALL_LETTER = "[A-Za-zÀ-ÿ][a-zß-öø-ÿ]|[a-zß-öø-ÿ][A-Za-zÀ-ÿ]"

#: Blanks as Python's strip() sees them, for the ranges that occur in texts.
BLANK = r"[\s   -     　]"
BLANKS = " \t\n\x0b\f\r\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def strip(text: Column) -> Column:
    """Without blanks, no-break ones included, on both ends."""
    return F.btrim(text, F.lit(BLANKS))


def blank(text: Column) -> Column:
    """Null, or blanks only; trimmed on the left, as that ends at the first other character."""
    return F.coalesce(F.ltrim(text, F.lit(BLANKS)), F.lit("")) == ""


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def looks_like_file(text: Column) -> Column:
    return text.rlike(FILE_SUFFIX)


def generic_alt(text: Column) -> Column:
    """A generic word, or up to three characters, once closing marks are gone."""
    bare = F.regexp_replace(F.lower(strip(text)), r"[.:;!? ]+$", "")
    return (bare != "") & (bare.isin(*GENERIC_ALT) | (F.char_length(bare) <= 3))


def all_caps(text: Column, least: int = 3) -> Column:
    words = words_of(text, "[A-Za-zÀ-ÿ]{2,}")
    return ~text.rlike(SMALL_LETTER) & (F.size(words) >= least) & F.forall(words, lambda w: (w == F.upper(w)) & (w != F.lower(w)))


def lacks_accent(text: Column) -> Column:
    """exists ends at the first such word; and what holds a lambda is compiled in methods of its own, not all in one."""
    words = words_of(F.lower(text), "[a-zà-ÿ]+")
    return F.exists(words, lambda w: w.isin(*NEEDS_ACCENT))


def acronyms(text: Column) -> Column:
    """Whole words of 3 to 8 capitals and digits that begin with a capital."""
    words = words_of(text, r"[\pL\pN_]+")
    return F.filter(words, lambda w: w.rlike("^[A-ZÀ-Ý][A-ZÀ-Ý0-9]{2,7}$"))


def vague_link(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"^[ .:;!?]+|[ .:;!?]+$", "")
    return bare.isin(*VAGUE_LINK)
