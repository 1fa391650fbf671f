"""Page shapes by hand, none of them from the generator: (page, words of the article)."""

def prose(r, n, vocab):
    out = []
    for _ in range(n):
        words = [str(w) for w in r.choice(vocab, int(r.integers(8, 18)))]
        out.append(" ".join(words).capitalize() + ("," if r.random() < 0.2 else "") + ".")
    return " ".join(out)


def shapes(r):
    vocab = [a + b + c for a in ("ba", "lo", "mi", "ter", "gan", "so", "ru", "vel") for b in ("ne", "ka", "ri", "to", "sha", "") for c in ("n", "st", "", "ra", "ll")]
    paras = [prose(r, int(r.integers(3, 7)), vocab) for _ in range(6)]
    title = prose(r, 1, vocab)[:-1]
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in r.choice(vocab, 8))
    flat = " | ".join(f"<a href='/{w}'>{w}</a>" for w in r.choice(vocab, 7))
    body = "".join(f"<p>{p}</p>" for p in paras)
    words = " ".join([title, *paras])
    yield (f"<html><head><title>{title}</title><style>p{{color:red}}</style></head><body><table width=100%><tr><td colspan=2>{flat}</td></tr><tr><td width=150>"
           f"<ul>{links}</ul></td><td><h1>{title}</h1>{body}</td></tr><tr><td colspan=2>Copyright 2009. All rights reserved. {flat}</td></tr></table></body></html>"), words
    yield (f"<body class='home page'><div id='wrap'><div class='top-bar'><span>Sign in</span><span>Cart (0)</span></div><div class='menu'><ul>{links}</ul></div>"
           f"<div class='content-area'><div class='post hentry'><h2 class='entry-title'>{title}</h2><div class='entry-content'>{body}</div><div class='sharing'><a>Tweet</a><a>Share</a></div></div>"
           f"<div id='comments' class='comments-area'><h3>2 comments</h3><div class='comment'><b>Ann</b> says: Great post, thank you for it!</div></div></div>"
           f"<div id='secondary' class='widget-area sidebar'><h3>Recent posts</h3><ul>{links}</ul></div></div><div class='site-footer'>Proudly powered. {flat}</div></body>"), words
    yield (f"<!doctype html><body><header><a class=logo href=/>Site</a><nav>{flat}</nav></header><main><article><header><h1>{title}</h1></header>{body}</article></main>"
           f"<aside><h4>Newsletter</h4><form><input type=email placeholder=mail><button>Subscribe now</button></form></aside><footer><p>Contact us. Imprint. Privacy.</p></footer></body>"), words
    yield (f"<body><div class=cookie-banner><p>We use cookies to improve this site. <button>Accept all</button></p></div><div class=layout><nav class=toc><ol>{links}</ol></nav>"
           f"<section class=docs><h1>{title}</h1>{paras and ''.join(f'<div class=para>{p}</div>' for p in paras)}</section></div><script>var x = 'p';</script></body>"), words
    lists = "".join(f"<li>{p}</li>" for p in paras[3:])
    yield (f"<body><div id=header><h3>Daily paper</h3>{flat}</div><div id=story><h1>{title}</h1><blockquote>{paras[0]}</blockquote><p>{paras[1]}<br>{paras[2]}</p><ul>{lists}</ul></div>"
           f"<div class=related><h3>Read more</h3><ul>{links}</ul></div><div class=ad>Advertisement: buy now</div></body>"), words
