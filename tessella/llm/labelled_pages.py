"""Labelled pages from which the extraction weights are learned.

Each page is a list of (html, label) pieces in page order; label 1 marks the article. W stands for running text of
that many words. The pages show layouts with and without semantic tags, with menus, headers, sidebars, adverts,
notices, forms, scripts, share bars, footers and reader comments.
"""

W = "word " * 40
S = "word " * 6

PAGES: list[list[tuple[str, int]]] = [
    [
        ("<html><head><title>word word</title></head><body><header><a href=/>word</a></header><nav><ul>" + "<li><a href=/x>word</a></li>" * 6 + "</ul></nav>", 0),
        (f"<article><h1>{S}</h1><p>{W}</p><p>{W}</p><h2>{S}</h2><p>{W}</p><ul><li>{S}</li><li>{S}</li></ul></article>", 1),
        (f"<aside><h3>word</h3><ul>" + "<li><a href=/y>word word</a></li>" * 5 + f"</ul></aside><footer>{S}<a href=/c>word</a></footer></body></html>", 0),
    ],
    [
        ("<body><div class=top><a href=/>word</a><a href=/>word</a><a href=/>word</a></div><div class=menu>" + "<a href=/m>word</a> | " * 8 + "</div>", 0),
        (f"<div id=main><h1>{S}</h1><p>{W}<b>word</b> {W}</p><p>{W}<a href=/l>word word</a> {W}</p><blockquote>{W}</blockquote><p>{W}</p></div>", 1),
        ("<div class=related><h3>word</h3>" + "<div><a href=/r>word word word</a></div>" * 4 + f"</div><div class=comments><p><b>word</b></p><p>{S}</p><p><b>word</b></p><p>{S}</p></div><div class=bottom>{S}</div></body>", 0),
    ],
    [
        ("<body><table><tr><td><a href=/1>word</a></td><td><a href=/2>word</a></td><td><a href=/3>word</a></td></tr></table><form><input><button>word</button></form>", 0),
        (f"<h2>{S}</h2>{W}<br><br>{W}<br><br>{W}<p>{W}</p>", 1),
        ("<hr><p><a href=/p>word</a> <a href=/n>word</a></p><p><small>word word word</small></p><table><tr><td><a href=/4>word</a></td></tr></table></body>", 0),
    ],
    [
        ("<body><div class=cookie-notice><p>" + S + "</p><button>word</button></div><nav><a href=/>word</a><a href=/>word</a></nav><main>", 0),
        (f"<article><header><h1>{S}</h1></header><p>{W}</p><p>{W}</p><p>{W}</p><pre>{S}</pre><p>{W}</p></article>", 1),
        ("<div class=share><a href=/f>word</a><a href=/t>word</a></div></main><section class=comments><h3>word</h3><ol><li><p>" + S + "</p></li><li><p>" + S + "</p></li></ol><form><textarea></textarea></form></section><footer><ul><li><a href=/a>word</a></li><li><a href=/b>word</a></li></ul></footer></body>", 0),
    ],
]
