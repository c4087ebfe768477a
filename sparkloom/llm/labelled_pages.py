"""Pages with their main text marked by hand, from which extraction learns: layouts as common site software makes them.

The main text stands between [[ and ]], without elements that have the attribute data-left-out. Another set of such pages can be given to the operator instead.
"""

PAGES = (
    # a news site: an article with its own header, an advert in the middle, links to read on, comments by readers
    """<!DOCTYPE html><html><head><title>River rises</title></head><body class="single nav-closed"><a class="skip-link" href="#main">Skip to content</a>
<header class="site-header"><div class="logo"><a href="/">The Daily Herald</a></div><nav class="main-nav"><ul><li><a href="/w">World</a></li><li><a href="/l">Local news</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Culture and arts</a></li></ul></nav></header>
<main id="main"><article class="post story">[[<header class="entry-header"><h1>River rises to its highest mark in ten years</h1><p class="standfirst">Roads along the banks were closed on Monday as water reached the old mill.</p></header>
<p>The river rose by more than a metre overnight, and people who live near the bridge were told to move their cars. Nobody was hurt.</p><figure><img src="a.jpg"><figcaption>The bridge on Monday morning.</figcaption></figure>
<div class="ad-slot advert" data-left-out><p>Advertisement</p><p>Get a new phone today and pay nothing for three months, only with us.</p></div>
<p>According to <a href="/mill">the keeper of the mill</a>, such a flood was last seen when he was a boy. "We carried everything upstairs," he said.</p><h2>What comes next</h2><p>Rain is expected until Thursday. The town has asked for help from its neighbours.</p>]]
<footer class="entry-footer"><div class="share-buttons">Share this story: <a href="/f">Mail</a> <a href="/t">Print</a></div><div class="tags">Filed under <a href="/t/r">River</a></div></footer></article>
<section id="comments" class="comments-area"><h3>Two comments</h3><ol class="comment-list"><li class="comment"><p class="comment-author">Anna</p><p>I live there, and it was worse than in the nineties. Great report, thank you for writing about it.</p></li><li class="comment"><p>They should have built the wall when there was money for it.</p></li></ol><form class="comment-form"><label>Name</label><input><label>Your comment</label><button>Post comment</button></form></section></main>
<aside class="sidebar widget-area"><div class="widget"><h3>Most read</h3><ul><li><a href="/1">School opens its doors again</a></li><li><a href="/2">Ten recipes for a cold evening</a></li></ul></div><div class="widget newsletter-signup"><p>Get our best stories every morning. Sign up for the newsletter and never miss a thing.</p></div></aside>
<footer class="site-footer"><p>&copy; The Daily Herald. All rights reserved.</p><ul><li><a href="/p">Privacy</a></li><li><a href="/i">Imprint</a></li></ul></footer></body></html>""",
    # a blog in plain divs, without elements that say what they are
    """<html><body><div id="wrapper"><div id="header"><div id="title"><a href="/">Notes from a garden</a></div><div id="menu"><a href="/about">About me</a> <a href="/archive">Archive</a> <a href="/contact">Contact</a></div></div>
<div id="content" class="narrow"><div class="post">[[<h2>How I keep bees</h2><div class="post-body"><p>Two years ago a neighbour gave me a hive. I knew nothing, so I read <i>every</i> book that I could find.</p><p>Most of them agree on one thing: leave the bees alone.</p><ul><li>Look into the hive once a week at most.</li><li>Wear light clothes and move slowly.</li></ul><p>In autumn there was honey, three jars of it.</p></div>]]
<div class="post-meta">Posted on 3 May by Tom in <a href="/bees">Bees</a></div></div><div id="replies" class="responses"><p>Lovely, we started last spring too and had no honey at all.</p></div></div>
<div id="right" class="column"><p>Search this site</p><form><input name="q"></form><h4>Blogroll</h4><ul><li><a href="/x">A pond</a></li><li><a href="/y">Old tools</a></li></ul></div><div id="footer" class="copyright"><p>Copyright by the author. Powered by a kettle.</p></div></div></body></html>""",
    # handbook pages: contents on the left, a notice on top, tables and code in the text
    """<body><div class="topbar navbar"><a href="/">Handbook</a><a href="/api">API</a><a href="/help">Help</a></div><div class="alert alert-warning notice" role="alert"><p>You are reading the handbook of an old version. Go to the newest one.</p></div>
<div class="container"><nav class="toc menu" role="navigation"><ul><li><a href="#a">Install</a></li><li><a href="#b">First steps</a></li><li><a href="#c">Tables</a></li></ul></nav><div class="breadcrumbs"><a href="/">Home</a> / <a href="/h">Handbook</a></div>
<main class="doc-content" role="main">[[<h1>First steps</h1><p>Open a window and type the following line. The answer appears at once.</p><pre>open table</pre><table><tr><th>Key</th><th>What it does</th></tr><tr><td>Enter</td><td>Runs the line that you typed.</td></tr><tr><td>Escape</td><td>Takes it away again.</td></tr></table><dl><dt>Row</dt><dd>One line of a table.</dd></dl><p>See also:</p><ul><li><a href="/h/1">How to sort a table</a></li><li><a href="/h/2">How to join two tables</a></li></ul>]]</main></div>
<div class="pager pagination"><a href="/h/0">Previous</a> <a href="/h/2">Next</a></div><footer><p>Edit this page</p><p>Last changed in March</p></footer></body>""",
    # a shop's guide: cookie banner, recommended goods, hidden dialogue
    """<body><div id="cookie-banner" class="cookie consent"><p>We use cookies to make this shop better for you. Do you accept all of them?</p><a href="#">Accept</a></div><div class="modal popup" style="display:none"><p>Wait, do not leave us yet, here are ten percent for you!</p></div>
<header role="banner"><a href="/">Paint and brush</a><div class="search"><form><input></form></div><div class="cart">Your cart is empty</div></header>
<section class="guide"><div class="inner">[[<h1>Painting a door</h1><p>A door takes a day. First take it off its hinges and lay it flat.</p></div><div class="inner"><h3>Sanding</h3><p>Sand along the grain until the old paint is dull, then wipe it with a damp cloth.</p><blockquote>Never paint in the sun.</blockquote></div><div class="inner"><h3>Painting</h3><p>Start with the panels and end with the edges.</p>]]</div></section>
<div class="related products"><h3>You may also like</h3><div class="card product"><a href="/b">Flat brush, 5 cm</a><p>Now only 4.99</p></div><div class="card product"><a href="/c">White paint for doors and windows</a><p>Sold out</p></div></div>
<div class="subscribe newsletter"><p>Subscribe for ideas and offers</p></div><div class="social"><p>Follow us</p></div><div role="contentinfo" class="bottom legal"><p>All prices with tax. Terms and conditions. Contact us by mail.</p></div></body>""",
    # an encyclopedia: body text with many links, a box of notes, categories
    """<body><div id="page-base"></div><div class="body" role="main"><div class="site-notice"><p>Please help us to keep this encyclopedia free, every gift counts.</p></div>[[<h1>Lime tree</h1><p>The <b>lime</b> is a tree of the family of <a href="/m">mallows</a>. It grows in the <a href="/t">temperate</a> north and may become <a href="/a">a thousand years old</a>.</p><h2>Use</h2><p>Its soft wood is good for <a href="/c">carving</a>; its flowers make a tea.</p><ol><li>Flowers are picked in June.</li><li>They are dried in the shade.</li></ol>]]
<div class="catlinks">Categories: <a href="/k1">Trees</a> | <a href="/k2">Plants of Europe</a></div></div><div class="navigation sidebar" role="navigation"><ul><li><a href="/">Main page</a></li><li><a href="/r">Random page</a></li><li><a href="/d">Donate</a></li></ul></div><div class="footer"><p>This text may be used freely. See the terms of use.</p></div></body>""",
    # old markup: a table for the layout, a form around all of it
    """<body><form id="page" action="/post"><table class="layout"><tr><td class="left"><a href="/">Start</a><br><a href="/club">The club</a><br><a href="/dates">Dates</a><br><a href="/links">Links</a></td><td class="main">[[<h1>Our club in winter</h1><p>The hall is heated again, so we train every Tuesday at seven. Bring shoes with white soles.<p>On the first Saturday of the month we play against the next village.<p>Beginners are welcome at any time.]]</td><td class="right banner"><p>Here could be your advertisement</p></td></tr></table></form></body>""",
    # text without any frame
    """<html><body>[[<p>It was late when we came to the inn. The landlord asked for our names and gave us a room under the roof.</p><p>In the morning there was snow.</p><div><p>We stayed for a week.</p></div><div><p>Nobody came up the road, and nobody went down.</p></div>]]</body></html>""",
    # a magazine: promoted items before the article, an author's box after it
    """<body><div class="masthead"><a href="/">Field and Stone</a></div><div class="promo promoted"><h4>Promoted</h4><p>Win a journey for two to the mountains, take part until Sunday.</p></div><div class="story-links"><a href="/q">Quarries</a> <a href="/k">Kilns</a> <a href="/w">Walls</a> <a href="/g">Gates and fences</a></div>
<article itemprop="articleBody"><header>[[<h1>The last lime kiln</h1><p class="byline-summary">A visit to a man who still burns lime as it was done long ago.</p></header><div class="text top-story"><p>Smoke rises from the hill before dawn. It takes three days and four cartloads of wood to burn one filling.</p><p class="lead-quote">"You smell when it is done," he says.</p></div>]]<aside class="infobox related-links"><p>More on lime: <a href="/l1">What lime is</a></p></aside><div class="author-box"><p>About the author: she writes about crafts and lives by the sea.</p></div></article>
<div class="sponsored recommended"><p>Around the web: this trick makes any wall dry in a week</p></div><footer><p>Advertise with us. Privacy and cookies.</p></footer></body>""",
    # a board: the question and its answer are the text, what stands around them is not
    """<body><div class="header"><a href="/">Tool board</a> <a class="login" href="/in">Log in</a> <a class="register" href="/up">Register</a></div><div class="content"><div class="main-content">[[<h1>Which oil for an old lathe?</h1><p>I have a lathe from 1950 and the plate with the oil on it is gone. What should I use?</p><p>Any thin oil for machines will do, as the bearings are wide. Fill it until it shows in the glass.</p>]]</div><div class="sidebar right-column"><p>Hot questions</p><ul><li><a href="/1">Sharpening a plane by hand</a></li></ul></div></div><div class="footer-links footer"><a href="/faq">Questions</a> <a href="/rules">Rules of this board</a></div></body>""",
    # a bare page as many small sites have it
    """<html lang="en"><head><meta charset="utf-8"><title>A walk</title><style>p{margin:0}</style></head><body><nav><ul><li><a href="/a">walks</a></li><li><a href="/b">maps</a></li></ul></nav><div class="ad">Shoes that never wear out, half off today.</div><article>[[<h1>A walk along the dyke</h1><p><b>The path starts at the lock and follows the water for two hours.<br><p>Halfway there is a bench. Sheep look after the grass.</p><p>Take the bus back.</p>]]</article><footer>&copy; walks &middot; written at home</footer></body></html>""",
    # elements without any attributes
    """<body><header><h2>Sea and shore</h2><p>A journal of the coast</p></header><nav><a href="/">Start</a> <a href="/old">Older texts</a></nav><main><article>[[<h1>Where seals rest</h1><p>At low tide the seals lie on the bank north of the harbour. From the pier you can count them, and on some days there are more than forty.</p><h2>When to come</h2><p>The best time is an hour before the water turns.</p><ul><li>Bring a glass.</li><li>Leave dogs at home.</li></ul><section><h3>How to get there</h3><p>A bus runs every hour from the station to the pier.</p></section>]]</article></main><aside><h3>Tides</h3><p>High water today at nine and at half past nine in the evening</p></aside><form><p>Write to us, your name and your mail please</p></form><footer><p>Printed on the island</p></footer></body>""",
    # an article that holds a column of other stories, a form and what readers wrote
    """<body><header class="top"><a href="/">The Valley Post</a></header><main><article>[[<h1>New bridge opens</h1><p>The bridge over the narrow river was opened on Friday. It took two years and cost more than was planned.</p>
<aside data-left-out><h3>Related stories</h3><p>Why the old bridge had to go</p><p>Ferries stop in the autumn</p></aside><p>The first to cross it was a farmer with two goats, who had waited since dawn.</p>
<form data-left-out><label>Your name</label><input name="n"><label>Your address for letters</label><button>Send</button><p>We write to you once a week and never share your address.</p></form><p>Lorries may use it from Monday on.</p>]]
<section class="discussion"><h2>Discussion</h2><p>Finally! I drove forty minutes every day because of this bridge.</p><p>Nice, but who pays for it in the end?</p></section></article></main><footer><p>The Valley Post, all rights reserved</p></footer></body>""",
    # a recipe: asides and forms in the text, remarks under it
    """<body><div class="head"><a href="/">Kitchen table</a></div><article class="recipe">[[<h1>Bread with walnuts</h1><p>This bread keeps for a week if you wrap it in linen.</p><aside data-left-out><p>Also on this site: rye bread, rolls with poppy seeds, flat bread</p></aside>
<h2>Dough</h2><p>Mix flour, water and salt and let it rest for an hour. Then add the yeast and the nuts.</p><form action="/vote" data-left-out><p>How did you like this recipe? Tell us with one to five stars.</p><label>Your remark</label><textarea></textarea></form><p>Bake it in a hot oven until it sounds hollow.</p>]]
<section class="discussion thread"><h3>What readers say</h3><p>I took hazelnuts instead, which worked just as well for us.</p><div class="reply"><p>Same here, and a little honey.</p></div></section></article></body>""",
    # a report in sections, which are its text; the last of them is of readers
    """<body><nav><a href="/">Home</a></nav><article>[[<section><h1>A year on the island</h1><p>We came in April, when the ferries start again, and stayed until the next spring.</p></section><section class="chapter"><h2>Winter</h2><p>From November on there was no post. We read all that we had, twice.</p><aside data-left-out><h4>More from this author</h4><p>Letters from the north, part one to nine</p></aside></section>
<section class="chapter"><h2>Spring</h2><p>The first boat brought oranges, and we ate them on the pier, one after the other.</p></section>]]<section class="discussion"><p>What a lovely text. I have been there as a child and it was just like that.</p><p>I would not have lasted a week.</p></section><form class="reply-form"><label>Write a reply</label><textarea></textarea></form></article></body>""",
)
