"""Layouts of pages for operator 7's training, written by hand after common kinds of site.

A layout is html with slots. Slots of main text: H a heading, P paragraphs in p, T bare prose, B a list, Q a quotation, S a
short line, C code, X a table. Slots of other text, in lower case: n links as a list, i links in a row, t a short text, p a paragraph
of prose, f a form, k a notice on cookies, c a line of copyright, d comments of readers. A slot is written {H}.
"""

from __future__ import annotations

LAYOUTS = (
    # plain documents
    "<body>{H}{P}</body>",
    "<body>{P}</body>",
    "<html><body>{P}{i}</body></html>",
    "<body><div>{P}</div></body>",
    "<body><div>{H}{P}{h}{P}</div></body>",
    "<body><h1>{S}</h1>{T}<br><br>{T}<br><br>{T}<hr>{c}</body>",
    "<body><center><h2>{S}</h2></center><font size=2>{T}<p>{T}<p>{T}</font><hr><a href=/>{t}</a></body>",
    "<body><pre>{C}</pre></body>",
    "<body><div>{T}</div><div>{T}</div><div>{T}</div></body>",
    # blogs
    '<body class="home blog"><div id="page"><header id="masthead" class="site-header"><p class="site-title"><a href="/">{t}</a></p><nav class="main-navigation">{n}</nav></header><div id="content" class="site-content"><div id="primary" class="content-area"><main id="main"><article class="post hentry"><header class="entry-header">{H}<div class="entry-meta">{t}</div></header><div class="entry-content">{P}{h}{P}{Q}{P}</div><footer class="entry-footer">{i}</footer></article><nav class="post-navigation">{i}</nav><div id="comments" class="comments-area">{d}</div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2>{t}</h2>{n}</section></aside></div><footer id="colophon">{c}</footer></div></body>',
    '<body><div class="navbar section">{i}</div><div class="header">{t}</div><div class="main section"><div class="blog-posts hfeed"><div class="post hentry"><h3 class="post-title entry-title">{S}</h3><div class="post-body entry-content">{T}<br/><br/>{T}<br/><br/>{T}</div><div class="post-footer">{t}</div></div></div><div class="comments">{d}</div></div><div class="sidebar section"><div class="widget">{n}</div><div class="widget">{p}</div></div><div class="footer">{c}</div></body>',
    '<body><div class="site-wrapper"><header class="gh-head"><nav>{n}</nav></header><main class="gh-main"><article class="article"><header>{H}<p class="article-excerpt">{T}</p></header><section class="gh-content">{P}{h}{P}{B}{P}</section></article><section class="footer-cta"><p>{t}</p>{f}</section></main><footer class="gh-foot">{c}</footer></div></body>',
    '<body><div id="header">{t}</div><div id="left">{n}</div><div id="center"><div class="item">{h}{P}</div><div class="item">{h}{P}</div></div><div id="right">{p}{n}</div><div id="bottom">{c}</div></body>',
    # news
    '<body><div class="ad-slot">{t}</div><header><div class="topbar">{i}</div><nav>{n}</nav></header><main><article><h1 class="headline">{S}</h1><p class="standfirst">{T}</p><div class="byline">{t}</div><figure><img src="a.jpg"><figcaption>{S}</figcaption></figure><div class="article-body">{P}<div class="advert">{t}</div>{P}<aside class="related"><h3>{t}</h3>{n}</aside>{P}</div></article><div class="share-tools">{i}</div><section class="most-read"><h2>{t}</h2>{n}</section></main><footer>{n}{c}</footer></body>',
    '<body><div class="page"><div class="top"><ul class="menu">{i}</ul></div><div class="story"><h1>{S}</h1><div class="date">{t}</div>{P}{P}</div><div class="right-rail"><div class="promo">{p}</div>{n}</div><div class="newsletter">{f}</div><div class="legal">{c}</div></div></body>',
    "<body><amp-sidebar>{n}</amp-sidebar><header>{t}</header><article>{H}{P}<amp-ad></amp-ad>{P}</article><div class=consent>{k}</div><footer>{c}</footer></body>",
    # encyclopedias and manuals
    '<body class="mediawiki"><div id="mw-page-base"></div><div id="content" class="mw-body" role="main"><h1 id="firstHeading">{S}</h1><div id="bodyContent"><div id="siteSub">{t}</div><div id="mw-content-text"><div class="mw-parser-output">{P}<div id="toc" class="toc"><h2>{t}</h2>{n}</div>{h}{P}{B}{h}{P}{X}</div></div><div id="catlinks">{i}</div></div></div><div id="mw-navigation"><div id="mw-panel">{n}{n}</div></div><div id="footer" role="contentinfo">{c}{n}</div></body>',
    "<body><div id=mw-content-text>{P}{h}{P}{h}{P}</div></body>",
    "<body><div class=wiki>{P}{h}{P}</div></body>",
    '<body><div class="related" role="navigation">{n}</div><div class="document"><div class="documentwrapper"><div class="bodywrapper"><div class="body" role="main"><section id="intro">{H}{P}<div class="highlight"><pre>{C}</pre></div>{P}<section>{h}{P}<dl><dt>{S}</dt><dd>{P}</dd></dl></section></section></div></div></div><div class="sphinxsidebar" role="navigation"><h3>{t}</h3>{n}</div></div><div class="footer" role="contentinfo">{c}</div></body>',
    '<body><header class="md-header">{t}{f}</header><div class="md-container"><nav class="md-tabs">{n}</nav><main class="md-main"><div class="md-sidebar md-sidebar--primary">{n}</div><div class="md-sidebar md-sidebar--secondary">{n}</div><div class="md-content"><article class="md-content__inner md-typeset">{H}{P}{h}{B}<pre><code>{C}</code></pre>{P}</article></div></main><footer class="md-footer">{c}</footer></div></body>',
    '<body><div class="breadcrumbs">{i}</div><div class="help-article">{H}<ol><li>{T}</li><li>{T}</li><li>{T}</li></ol>{P}</div><div class="article-votes">{t}</div><div class="recent-articles">{n}</div></body>',
    '<body><div class="gitbook-root"><div class="book-summary">{n}</div><div class="book-body"><div class="page-inner"><section class="normal markdown-section">{H}{P}{C}{P}</section></div></div></div></body>',
    # tables for layout
    "<body><table width=100%><tr><td colspan=3>{t}</td></tr><tr><td width=150 valign=top>{n}</td><td valign=top>{H}{P}</td><td width=120>{i}</td></tr><tr><td colspan=3>{c}</td></tr></table></body>",
    "<body><table border=0><tr><td bgcolor=#eeeeee>{i}</td><td>{T}<p>{T}<p>{T}</td></tr></table></body>",
    "<body><table><tr><td><a href=a>{t}</a><br><a href=b>{t}</a><br><a href=c>{t}</a><br></td><td><h1>{S}</h1>{T}<br><br>{T}</td></tr></table><center>{c}</center></body>",
    # questions, forums, mail
    '<body><header class="top-bar">{n}</header><div id="content"><div id="question-header"><h1>{S}</h1></div><div id="mainbar"><div class="question"><div class="post-text">{P}<pre>{C}</pre></div><div class="post-menu">{i}</div></div><div class="answer"><div class="post-text">{P}</div><div class="comments">{d}</div></div></div><div id="sidebar">{n}</div></div><div id="footer">{c}</div></body>',
    "<body><ul class=nav>{i}</ul><h1>{S}</h1><pre>{C}</pre><hr><ul>{i}</ul></body>",
    # shops, recipes, offices, homes of people
    '<body><div class="announcement-bar">{k}</div><header>{n}{f}</header><main><div class="product"><h1 class="product-title">{S}</h1><div class="product-description">{P}{B}</div></div><div class="recommendations"><h2>{t}</h2>{i}</div></main><footer>{n}{c}</footer></body>',
    '<body><nav>{n}</nav><div class="recipe"><h1>{S}</h1><div class="summary">{T}</div><h2>{S}</h2>{B}<h2>{S}</h2><ol><li>{T}</li><li>{T}</li></ol></div><div class="ratings">{d}</div><footer>{c}</footer></body>',
    '<body><a class="skip" href="#main">{t}</a><div class="cookie-banner">{k}</div><header class="banner">{t}</header><main id="main" role="main"><div class="grid-row"><div class="column-two-thirds">{H}{P}{h}{P}</div><div class="column-third"><nav>{n}</nav></div></div></main><footer role="contentinfo">{n}{c}</footer></body>',
    "<body><h1>{S}</h1><img src=me.jpg><p>{T}</p><h2>{S}</h2><ul><li>{T}<li>{T}</ul><h2>{S}</h2>{P}<address>{c}</address></body>",
    '<body><div class="container"><div class="row"><div class="col-md-3">{n}</div><div class="col-md-9">{H}{P}{X}{P}</div></div><div class="row">{c}</div></div></body>',
    '<body><section class="hero"><h1>{S}</h1><p>{T}</p></section><section class="features">{P}{P}</section><section class="signup">{f}</section><footer>{c}</footer></body>',
    '<body><details><summary>{S}</summary>{P}</details><details><summary>{S}</summary>{P}</details><footer>{c}</footer></body>',
    '<body><div class="top">{n}</div><div class="text"><h2>{S}</h2><div>{T}</div><div>{T}</div><div>{T}</div></div><div class="login">{f}</div><div class="ads">{p}</div></body>',
    '<body><div id="app"><div class="sc-1a2b3c"><div class="css-9x8y">{i}</div><div class="css-7q"><h1>{S}</h1><div class="css-5t">{P}</div></div><div class="css-3z">{c}</div></div></div></body>',
    '<body><nav class="flex md:px-4 w-full bg-white sticky">{n}</nav><div class="max-w-prose mx-auto px-4 py-8">{H}{P}{h}{P}</div><div class="w-64 p-2 hidden lg:block sidebar">{n}{p}</div><div class="border-t text-sm">{c}</div></body>',
    '<body><div class="poem"><h2>{S}</h2><p>{S}<br>{S}<br>{S}</p><p>{S}<br>{S}<br>{S}</p></div><div class="menu">{i}</div></body>',
    "<body><h1>{S}</h1><h3>{S}</h3><p>{T}<p>{T}<blockquote>{T}</blockquote><p>{T}<p><a href=/>{t}</a></body>",
    # pages without an article
    '<body><header>{t}</header><nav>{n}</nav><div class="results">{i}</div><footer>{c}</footer></body>',
    '<body><div class="login-box">{f}</div><footer>{n}{c}</footer></body>',
    '<body><div class="menu">{n}</div><div class="cookie">{k}</div></body>',
)
